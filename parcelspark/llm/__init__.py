"""Training-data operators: scoring, extraction, deduplication, scanning, encoding."""
