"""Spark-native incremental matrix factorization."""
