"""Spark-native operators for deduplicating, decontaminating and preparing text corpora."""
