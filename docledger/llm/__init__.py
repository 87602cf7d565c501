"""Operators for large training-data pipelines: deduplication, search, extraction, packing, mixing, scoring and counting."""
