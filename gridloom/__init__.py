"""Spark-native analytics over gridded cells, points and vectors."""
