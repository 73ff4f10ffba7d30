"""Spark-native analytics over typed graphs of changes, obligations and evidence."""
