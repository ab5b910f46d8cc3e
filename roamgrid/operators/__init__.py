"""Operators on road-network DataFrames."""
