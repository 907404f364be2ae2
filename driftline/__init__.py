"""Text-distribution analytics on Spark DataFrames."""
