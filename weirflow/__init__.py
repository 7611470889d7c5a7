"""Row-flow analytics on Spark DataFrames."""
