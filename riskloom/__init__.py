"""Table operators and batch jobs for software-risk analytics on Spark DataFrames."""
