"""Operators on DataFrames: cleaning, profiling, features, ranges, evaluation, attribution."""
