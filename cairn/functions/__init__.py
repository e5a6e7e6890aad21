"""cairn.functions."""
