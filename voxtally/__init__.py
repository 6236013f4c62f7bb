"""Spark-native analytics over audience comments."""
