"""Column expressions and ordered-row helpers."""
