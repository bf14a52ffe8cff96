"""Operators for large text corpora (sharding, joins, filters, scoring, packing, formatting)."""
