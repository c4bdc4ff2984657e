"""Keyed commodity-panel analytics on Spark DataFrames."""
