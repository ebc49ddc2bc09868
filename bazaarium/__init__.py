"""Price-intelligence analytics on Spark DataFrames."""
