"""Labelled multi-dimensional arrays in Spark DataFrames."""

__version__ = "0.1.0"
