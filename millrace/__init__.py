"""A Spark-native analytics engine: pure DataFrame operators over declared plans."""

__version__ = "0.1.0"
