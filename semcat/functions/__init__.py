"""Column expressions: no operator here looks at more than one row."""
