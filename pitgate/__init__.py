"""Point-in-time data quality on Spark: every operator takes and returns DataFrames."""

from pitgate.schema import Rules

__all__ = ["Rules"]
__version__ = "0.1.0"
