"""App-corpus threat analytics on Spark DataFrames."""
