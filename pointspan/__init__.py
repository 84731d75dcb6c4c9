"""pointspan: a Spark-native engine for spatial point search."""

__version__ = "0.1.0"
