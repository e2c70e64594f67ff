"""Operators over organism events: DataFrames in, DataFrames out."""
