"""The lazy plan, its rewrites, and its lowering to DataFrames."""
