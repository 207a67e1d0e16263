"""canasta: retail basket analytics as plain Spark DataFrames."""

__version__ = "0.1.0"
