"""Column functions: dates, text, keys and interval predicates."""
