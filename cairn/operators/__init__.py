"""cairn.operators."""
