"""Spark-native analytics for wiki dumps, wiki markup and text corpora."""

__version__ = "0.1.0"
