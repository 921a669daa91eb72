"""Spark-native document cleaning, chunking and retrieval."""
