"""Spark-native full-text, nested-data and reporting analytics."""
