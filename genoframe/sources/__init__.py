"""sources of genoframe."""
