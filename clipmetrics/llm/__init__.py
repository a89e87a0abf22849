"""Operators for large training-data corpora: deduplication, search, mixing, scoring, packing and chat formatting."""
