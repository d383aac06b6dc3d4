"""Statistical and machine-learning jobs over Spark DataFrames."""
