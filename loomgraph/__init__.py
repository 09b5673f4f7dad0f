"""Hypergraph analytics over Spark DataFrames."""
