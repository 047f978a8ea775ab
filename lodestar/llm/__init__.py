"""Operators for building training data: extraction, deduplication, filtering, tokenising, packing and formatting."""
