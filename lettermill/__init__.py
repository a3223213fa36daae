"""Spark-native message and text analytics."""
