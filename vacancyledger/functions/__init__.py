"""Column expressions: text, URLs, dates, locations and score arithmetic."""
