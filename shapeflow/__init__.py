"""Time-series trend analytics and training-data operators on Spark DataFrames."""
