"""Feature, rule and model operators on DataFrames."""
