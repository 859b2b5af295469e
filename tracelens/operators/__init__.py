"""Operators that take DataFrames and give DataFrames."""
