"""Selective-prediction analytics on Spark DataFrames."""
