"""Value-grouped sparse matrices as Spark DataFrames."""
