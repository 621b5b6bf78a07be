"""Few-shot sequence and vector analytics on Spark DataFrames."""
