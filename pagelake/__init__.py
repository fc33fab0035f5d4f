"""Spark-native engine for captured web data."""
