"""Temporal-network analytics on Spark DataFrames."""
