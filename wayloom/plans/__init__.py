"""Whole requests composed of operators."""
