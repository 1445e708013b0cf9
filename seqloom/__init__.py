"""Spark-native analytics for sequencing reads."""
