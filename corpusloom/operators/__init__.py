"""Relational operators: joins, windows and aggregations over corpus tables."""
