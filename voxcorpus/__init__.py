"""Spark-native measures of how a body of writing sounds."""
