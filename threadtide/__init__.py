"""Spark-native analysis of discussion threads around dated events."""
