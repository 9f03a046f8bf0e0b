"""Spark-native analytics for agricultural aerial surveys."""
