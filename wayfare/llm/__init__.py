"""Operators for preparing training corpora: deduplication, quality, toxicity, search, mixing, tokens."""
