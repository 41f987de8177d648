"""Lodestone: a PySpark-native engine for configuration-knowledge analytics."""

__version__ = "0.1.0"
