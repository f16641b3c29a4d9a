"""Hourly sensor-series analytics on Spark DataFrames."""
