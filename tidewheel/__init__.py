"""Plant-month analytics on Spark DataFrames."""
