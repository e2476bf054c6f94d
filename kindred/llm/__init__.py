"""Operators of a training-data pipeline: deduplication, filtering, scanning, tokenising and sharding of documents."""
