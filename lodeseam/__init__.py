"""Retrieval and corpus analytics over code and text collections, on Spark DataFrames."""

__version__ = "0.1.0"
