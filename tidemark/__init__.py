"""Token-stream signal analytics on Spark DataFrames and Structured Streaming."""
