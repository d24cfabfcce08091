"""Timed-event analytics on Spark DataFrames."""
