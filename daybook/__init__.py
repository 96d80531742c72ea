"""Calendar and contact data in Spark DataFrames."""
