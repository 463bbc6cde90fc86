"""Operators of a training-data pipeline: cleaning, dedup, scoring and packing of documents."""
