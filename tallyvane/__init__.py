"""Confidence-aware retrieval and evaluation analytics on Spark DataFrames."""
