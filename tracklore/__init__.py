"""Spark-native analysis of per-entity time series and labelled intervals."""
