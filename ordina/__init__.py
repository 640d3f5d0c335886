"""Ordered and partition-aware data processing on Spark DataFrames."""
