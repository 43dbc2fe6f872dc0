"""Shoreline-change analytics on Spark DataFrames."""
