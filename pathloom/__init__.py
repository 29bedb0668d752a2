"""A path-and-pipe filter language for JSON and tables, planned as Spark DataFrames."""
