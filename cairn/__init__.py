"""cairn: a PySpark-native engine for operational text, code and trial data."""

__version__ = "0.1.0"
