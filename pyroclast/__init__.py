"""Spark-native analytics for regulations, drawings, reviews and training text."""
