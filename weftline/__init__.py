"""weftline: Spark-native analytics for internet-topology and measurement data."""

__version__ = "0.1.0"
