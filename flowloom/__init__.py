"""Network-flow analytics on Spark DataFrames, Spark ML and Structured Streaming."""
