"""A metrics engine on Spark DataFrames."""
