"""Spark-native engine to prepare, audit and score text and speech corpora."""
