"""Text-compression analytics on Spark DataFrames."""
