"""Spark-native operators for the data side of a machine fleet."""
