"""Relational operators: graph, routing, spatial joins, search and addresses."""
