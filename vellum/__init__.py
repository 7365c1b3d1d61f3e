"""A document-graph analytics engine on Spark DataFrames."""
