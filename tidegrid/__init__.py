"""tidegrid: a PySpark-native analytics engine for market and portfolio risk data."""

__version__ = "0.1.0"
