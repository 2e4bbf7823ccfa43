"""nearfield: proximity-graph analytics on Spark DataFrames."""
