"""Column functions: everything here builds expressions of Spark's own functions."""
