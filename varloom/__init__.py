"""varloom: long-read variant analytics and corpus preparation on Spark DataFrames."""
