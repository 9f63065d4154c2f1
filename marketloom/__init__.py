"""Equity research analytics on Spark DataFrames."""
