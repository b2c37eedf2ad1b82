"""Screening and geo-vector analytics, and training-data preparation, as Spark DataFrames."""
