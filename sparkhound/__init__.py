"""Spark-native analytics over program facts."""
