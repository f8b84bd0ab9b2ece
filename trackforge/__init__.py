"""trackforge: interval tracks and queries on Spark DataFrames."""
