"""Spark-native engine for event sequences: DataFrame in, DataFrame out."""
