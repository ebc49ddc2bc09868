"""Column functions: text, fuzzy matching, numbers, prices, links and JSON-LD."""
