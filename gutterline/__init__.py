"""Page-layout and timeline analytics on Spark DataFrames."""
