"""Property-graph analytics for code intelligence, as Spark DataFrames."""
