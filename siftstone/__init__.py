"""Spark-native index and pruning engine over Parquet datasets."""

__version__ = "0.1.0"
