"""Relational and scalar operators: syntax in, DataFrames and Columns out."""
