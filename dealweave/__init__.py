"""Co-investment analytics and data preparation on Spark DataFrames."""
