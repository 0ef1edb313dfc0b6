"""Readers that turn files into DataFrames with fixed schemas."""
