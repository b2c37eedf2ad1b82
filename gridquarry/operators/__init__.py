"""Operators over tables: DataFrames in, a DataFrame out."""
