"""Demand forecasting and inventory decisions as composable Spark operators."""

__version__ = "0.1.0"
