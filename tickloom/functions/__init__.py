"""Operators as functions with parameters, over DataFrames with any column names."""
