"""Operators for large-scale preparation of language-model training data."""
