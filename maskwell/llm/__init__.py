"""Operators for training data: cleaning, near-duplicates, contamination, tokens, shards."""
