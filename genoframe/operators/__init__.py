"""operators of genoframe."""
