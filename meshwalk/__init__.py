"""Property-graph analytics on Spark: catalogs of node and edge DataFrames, traversals and algorithms."""
