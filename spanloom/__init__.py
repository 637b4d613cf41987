"""Spark-native analytics for fixed-format system event records."""
