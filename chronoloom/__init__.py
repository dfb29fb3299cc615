"""Spark-native analytics over bitemporal fact graphs."""
