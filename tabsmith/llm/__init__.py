"""Operators of a training-data pipeline: text, secrets, packing, near duplicates."""
