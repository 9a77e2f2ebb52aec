"""Spark-native batch recommendations over catalogue, listening and request tables."""
