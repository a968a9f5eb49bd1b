"""Spark-first search and data processing over place-name style tables."""
