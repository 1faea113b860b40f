"""Spark-native analytics over ensembles of ordered three-dimensional point sequences."""

__version__ = "0.1.0"
