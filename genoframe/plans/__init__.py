"""plans of genoframe."""
