"""Quillmere: a Spark-native engine that treats a tree of markdown pages as a queryable corpus."""

__version__ = "0.1.0"
