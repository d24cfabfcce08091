"""Column builders: text, symbols, formats."""
