"""Mesh, graph and sparse-data analytics on Spark DataFrames."""
