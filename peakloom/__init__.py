"""Peak-event analytics on Spark DataFrames."""
