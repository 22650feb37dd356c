"""Operators of a training-data pipeline: documents in, DataFrames out."""
