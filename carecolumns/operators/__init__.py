"""Operators over DataFrames of subjects."""
