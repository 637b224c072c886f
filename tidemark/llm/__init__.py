"""Operators for large-scale training-data pipelines: deduplication, mixing, tokenizing, archives, filters."""
