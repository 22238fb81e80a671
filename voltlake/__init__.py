"""voltlake: a PySpark-native engine for dense recordings and sorted spike tables."""

__version__ = "0.1.0"
