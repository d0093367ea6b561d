"""Reading tables and seeds, writing and publishing tables."""
