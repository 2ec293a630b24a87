"""turnwise: a PySpark-native analytics engine for turn-structured text and event data."""

__version__ = "0.1.0"
