"""functions of genoframe."""
