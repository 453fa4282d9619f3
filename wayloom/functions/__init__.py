"""Column expressions: geometry, tags and text."""
