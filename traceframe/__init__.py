"""Operational text, event and source-code analytics on Spark DataFrames."""
