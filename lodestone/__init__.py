"""Spark-native retrieval and text analytics."""
