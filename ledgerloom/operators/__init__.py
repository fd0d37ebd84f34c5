"""Matching, inbox recommendations and anomaly rules: DataFrames in, DataFrames out."""
