"""Outcome-study analytics on Spark DataFrames."""
