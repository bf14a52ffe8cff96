"""Composed plans: the registered queries and their DuckDB oracle texts."""
