"""Rule-and-relationship queries over captured facts, as Spark DataFrames."""
