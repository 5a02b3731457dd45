"""Spark-native engine for preparing, transforming and evaluating code and text corpora."""
