"""carda: listing-data quality and marketplace analytics on PySpark DataFrames."""

__version__ = "0.1.0"
