"""Spark-native retrieval corpus engine."""
