"""Operators on DataFrames; none of them collects data to the driver."""
