"""Meter time-series analytics as Spark DataFrames."""
