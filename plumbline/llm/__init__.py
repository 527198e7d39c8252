"""Operators of a training-data pipeline: scoring, deduplication, search, tokens and packing."""
