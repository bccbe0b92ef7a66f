"""Operators: DataFrames, column names and thresholds in, DataFrame out."""
