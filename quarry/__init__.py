"""quarry: Spark-native reconciliation, mart building, retrieval and randomness analytics."""

__version__ = "0.1.0"
