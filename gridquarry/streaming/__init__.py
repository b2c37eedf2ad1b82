"""Structured Streaming queries and their batch twins."""
