"""Retail demand forecasting and stock replenishment on Spark DataFrames."""

__version__ = "0.1.0"
