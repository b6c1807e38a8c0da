"""Sequence and assembly-graph analytics on Spark DataFrames."""
