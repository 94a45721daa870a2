"""Search, centroid and node operators: pure functions from DataFrames to DataFrames."""
