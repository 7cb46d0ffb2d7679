"""Statistics, data preparation and evaluation over Spark DataFrames."""
