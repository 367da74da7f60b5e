"""Column expressions: tokens, timestamps, names."""
