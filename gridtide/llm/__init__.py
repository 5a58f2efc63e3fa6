"""Operators for large text corpora: search, tokenising, filtering, dedup, privacy, packing."""
