"""Property-graph analytics and corpus processing on plain Spark DataFrames."""
