"""Column expressions: text normalisation, parsing, column-role rules."""
