"""Operators over event and catalog DataFrames."""
