"""Operators on pages and zones, DataFrame to DataFrame."""
