"""heddle: a PySpark-native engine for relational, keyed, versioned, search and change-stream queries."""

__version__ = "0.1.0"
