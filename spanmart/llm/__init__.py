"""Operators for building training data out of text tables."""
