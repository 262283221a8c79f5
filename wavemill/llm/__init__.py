"""Operators for preparing text corpora: quality, deduplication, mixing, tokens."""
