"""Property-graph analytics on Spark: graph queries compiled to DataFrames."""
