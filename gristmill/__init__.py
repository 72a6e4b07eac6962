"""gristmill: content-intelligence and training-data jobs written as Spark DataFrames."""
