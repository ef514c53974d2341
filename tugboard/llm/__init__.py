"""Operators for preparing training data: deduplication, filtering, mixing, tokens and scores."""
