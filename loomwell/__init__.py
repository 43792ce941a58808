"""Loomwell: a PySpark-native engine for structured, compounding knowledge."""

__version__ = "0.1.0"
