"""cairn.sources."""
