"""Spark-native tracing and measurement of label-assignment pipelines."""

__version__ = "0.1.0"
