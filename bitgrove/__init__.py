"""Spark-native analytics over binary hypervectors and typed edges."""

__version__ = "0.1.0"
