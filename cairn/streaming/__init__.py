"""cairn.streaming."""
