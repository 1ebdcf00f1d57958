"""Shoal: hierarchical clustering of moving points, declared with Spark DataFrames."""
