"""Operators for preparing training data: search, tokens, filters, mixing, deduplication."""
