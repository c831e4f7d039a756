"""Spark-native analytics over many univariate series held in one DataFrame."""

__version__ = "0.1.0"
