"""Operators for large training corpora: deduplication, tokens, archives, search, models and packing."""
