"""Column expressions: text, dates, vectors."""
