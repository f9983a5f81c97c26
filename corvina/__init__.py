"""Spark-native engine for content and catalog data."""
