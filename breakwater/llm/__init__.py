"""Training-data operators: tokenising, filtering, near-duplicate search, scoring and media columns."""
