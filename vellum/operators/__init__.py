"""Relational operators over the graph's DataFrames."""
