"""Motion and match analytics on Spark DataFrames."""
