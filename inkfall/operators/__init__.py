"""Operators over document, chunk and table DataFrames."""
