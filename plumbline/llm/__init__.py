"""Operators for training-data pipelines: sharding, filtering, deduplication, encoding."""
