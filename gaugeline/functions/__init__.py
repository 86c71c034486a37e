"""Column expressions and small value parsers."""
