"""Spark-native analytics over streams of nested organism events."""
