"""Operators for large training-data pipelines: one module each, on plain DataFrames."""
