"""streaming of genoframe."""
