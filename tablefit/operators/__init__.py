"""Table operators: every one takes DataFrames and returns DataFrames or models."""
