"""Column functions: text, dates, keys, urls and vectors."""
