"""Training-data curation and evaluation analytics on Spark DataFrames."""
