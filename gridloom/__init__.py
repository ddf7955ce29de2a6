"""Spark-native analytics over pixel observations, polygons and task events."""
