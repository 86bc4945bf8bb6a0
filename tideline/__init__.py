"""Time-series data quality as Spark plans."""
