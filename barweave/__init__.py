"""Bar-series analytics on Spark DataFrames."""
