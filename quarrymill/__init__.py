"""quarrymill: a PySpark-native analytics engine for text-and-evidence corpora."""

__version__ = "0.1.0"
