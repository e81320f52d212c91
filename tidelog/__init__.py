"""Spark-native analytics over append-only key-value logs."""
