"""Spark-native document search, ranking and corpus preparation."""
