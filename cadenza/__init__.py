"""Score and onset-event analytics on Spark DataFrames."""
