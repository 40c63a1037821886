"""Column expressions: paths, lines, tokens."""
