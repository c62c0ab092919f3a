"""Operators of a training-data pipeline, on Spark DataFrames.

Nothing outside this subpackage imports it.
"""
