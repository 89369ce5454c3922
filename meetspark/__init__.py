"""meetspark: a PySpark-native engine for conversation and meeting data."""

__version__ = "0.1.0"
