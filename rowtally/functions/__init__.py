"""Column expressions: keys, cell values and column names."""
