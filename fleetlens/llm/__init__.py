"""Training-data operators: extraction, scoring, filtering, deduplication, formatting, encoding."""
