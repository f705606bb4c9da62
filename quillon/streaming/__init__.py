"""The stateless document jobs on streaming DataFrames."""
