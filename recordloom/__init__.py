"""Spark-native analytics over semi-structured records."""
