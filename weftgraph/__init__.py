"""Spark-native analytics over software dependency graphs."""
