"""Operators for a training-data pipeline: clean, deduplicate, score, encode and store."""
