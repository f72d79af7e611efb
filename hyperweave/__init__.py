"""Spark-native hypergraph clustering engine."""

__version__ = "0.1.0"
