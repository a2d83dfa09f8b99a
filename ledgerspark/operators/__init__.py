"""Operators on ledger tables, each a function from DataFrames to DataFrames."""
