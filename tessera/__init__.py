"""Spark-native engine for building, cleaning, scoring and judging text and source-code corpora."""
