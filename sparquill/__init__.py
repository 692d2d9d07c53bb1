"""Document and evidence analytics on Spark DataFrames."""
