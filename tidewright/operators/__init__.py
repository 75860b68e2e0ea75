"""Operators on DataFrames; none of them reads or writes by itself."""
