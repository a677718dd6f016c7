"""Queries over the given tables, by family."""
