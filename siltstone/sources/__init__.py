"""File trees as DataFrames."""
