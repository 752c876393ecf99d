"""Operators over DataFrames, grouped by the stage of the record they serve."""
