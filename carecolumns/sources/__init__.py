"""Specifications and their catalogue."""
