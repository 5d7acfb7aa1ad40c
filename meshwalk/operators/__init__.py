"""Graph operators: algorithms, lanes, vector search, statistics."""
