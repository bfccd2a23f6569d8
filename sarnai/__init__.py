"""Spark-native engine for multi-script text processing and the data around it."""

__version__ = "0.1.0"
