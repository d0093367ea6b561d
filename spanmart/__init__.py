"""Validity intervals, marts and data-quality checks as PySpark DataFrame jobs."""
