"""Spark-native customer analytics: warehouse queries, data quality, statistics and generation."""
