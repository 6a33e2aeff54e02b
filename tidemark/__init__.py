"""Tidemark: Spark-native time-series analytics over rows keyed by symbol, timeframe and timestamp."""

__version__ = "0.1.0"
