"""Composed pipelines, stand-in tables and the registered queries."""
