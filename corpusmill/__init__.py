"""corpusmill: a Spark-native corpus analytics engine."""

__version__ = "0.1.0"
