"""Geospatial detection analytics on Spark DataFrames."""
