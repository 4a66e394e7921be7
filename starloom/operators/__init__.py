"""Operators: plain functions from DataFrames to DataFrames, generic over column names."""
