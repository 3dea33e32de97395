"""Elastic principal graphs over point clouds held in Spark DataFrames."""

__version__ = "0.1.0"
