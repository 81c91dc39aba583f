"""Column expressions: text, numbers, hashes."""
