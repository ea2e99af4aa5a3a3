"""Compressibility analytics over numeric arrays, expressed as Spark DataFrames."""

__version__ = "0.1.0"
