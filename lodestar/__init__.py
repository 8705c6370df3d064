"""Spark-native search and curation of large embedding datasets."""
