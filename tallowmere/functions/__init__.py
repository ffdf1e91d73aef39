"""Column expressions: numbers, texts, identities."""
