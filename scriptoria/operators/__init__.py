"""Relational building blocks: predicates, joins, aggregations, windows, ranking, set operations."""
