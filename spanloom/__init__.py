"""Spark-native analytics over execution traces and the data that moves through them."""
