"""Operators of a large-scale training-data pipeline (deduplication, extraction, filtering, packing)."""
