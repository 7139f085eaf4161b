"""Credit-risk style feature, rule and model analytics on Spark DataFrames."""
