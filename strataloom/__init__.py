"""Log-pattern analytics on Spark DataFrames."""
