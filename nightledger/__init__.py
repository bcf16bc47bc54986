"""Short-term-rental analytics on Spark DataFrames."""
