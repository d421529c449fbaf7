"""Operators for large training-text pipelines, and the queries that apply them."""
