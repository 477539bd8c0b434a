"""Operators over series, intervals and their measures: DataFrames in, DataFrames out."""
