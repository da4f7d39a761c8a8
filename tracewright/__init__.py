"""Session-transcript analytics on Spark DataFrames."""
