"""Operators of a training-data pipeline: dedup, filtering, mixing, archives, search, tokens."""
