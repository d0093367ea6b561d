"""Queries over the shared test tables, each with its SQL counterpart."""
