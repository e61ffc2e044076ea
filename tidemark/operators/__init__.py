"""Operators on DataFrames: each takes and returns DataFrames and collects nothing that grows with the data."""
