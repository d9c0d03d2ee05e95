"""Similarity search and data processing over embedding collections, as Spark DataFrame plans."""

__version__ = "0.1.0"
