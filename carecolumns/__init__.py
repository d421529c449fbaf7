"""Declarative medical formulas, scores, conversions and lookups evaluated over whole DataFrames of subjects."""
