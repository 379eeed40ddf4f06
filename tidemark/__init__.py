"""Tidemark: a Spark-native store and analytics engine for regular time series."""
