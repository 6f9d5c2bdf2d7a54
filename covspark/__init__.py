"""A detection-coverage engine on Spark DataFrames."""
