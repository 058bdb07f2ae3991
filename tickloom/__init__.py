"""tickloom: PySpark-native analytics for intraday market data."""

__version__ = "0.1.0"
