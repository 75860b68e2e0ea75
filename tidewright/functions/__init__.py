"""Column functions: text, dates, numbers, links."""
