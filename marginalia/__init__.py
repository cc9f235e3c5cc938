"""Spark-native analytics for positional annotation data."""
