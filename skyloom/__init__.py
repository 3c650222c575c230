"""Observer-centred views of periodic simulation boxes as Spark DataFrames."""
