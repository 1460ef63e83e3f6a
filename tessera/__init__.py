"""Spark-native document analytics, retrieval and corpus processing."""
