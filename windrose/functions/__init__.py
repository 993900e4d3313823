"""Column expressions and the strict parsers of provider answers."""
