"""Typed, time-versioned facts on Spark DataFrames."""
