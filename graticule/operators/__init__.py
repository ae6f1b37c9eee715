"""Operators: DataFrames in, DataFrames out, keyed by point id."""
