"""Content-archive analytics and corpus operations on PySpark DataFrames."""

__version__ = "0.1.0"
