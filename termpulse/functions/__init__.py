"""Column expressions: text, dates, scores."""
