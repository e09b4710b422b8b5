"""Repository and document analytics on Spark DataFrames."""
