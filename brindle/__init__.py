"""Market-data and event analytics on Spark DataFrames."""
