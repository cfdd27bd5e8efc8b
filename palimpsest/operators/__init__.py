"""Relational operators: gates, joins, walks, windows."""
