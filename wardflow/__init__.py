"""Clinical analytics operators on Spark DataFrames."""
