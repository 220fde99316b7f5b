"""Fixture views and the catalogue of queries with their DuckDB statements."""
