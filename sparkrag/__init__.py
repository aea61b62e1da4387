"""A PySpark-native engine for building and evaluating retrieval-augmented generation pipelines."""

__version__ = "0.1.0"
