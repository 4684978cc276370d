"""Spark-native analysis of structured binary artifacts and text corpora."""

__version__ = "0.1.0"
