"""Spark-native alignment of token streams with an ordered reference corpus."""
