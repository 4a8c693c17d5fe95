"""Leakage-safe listings analytics as plain functions over Spark DataFrames."""
