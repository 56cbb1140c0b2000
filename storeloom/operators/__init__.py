"""Operators: DataFrame in, DataFrame out; no paths, no table-specific column names."""
