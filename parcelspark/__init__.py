"""Location and land analytics on Spark DataFrames."""
