"""Spark-native analytics over corpora of multi-part records."""

__version__ = "0.1.0"
