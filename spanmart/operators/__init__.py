"""Operators on DataFrames: intervals, joins, dedupe, unions, PII, quality, metrics."""
