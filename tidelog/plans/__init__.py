"""Statements to DataFrames."""
