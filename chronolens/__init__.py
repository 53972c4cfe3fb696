"""Spark-native time-series inference."""
