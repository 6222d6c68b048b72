"""quernel: a Spark-native hybrid retrieval and corpus engine."""

__version__ = "0.1.0"
