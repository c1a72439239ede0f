"""Operators of a training-data pipeline: extraction, quality, scoring, deduplication, packing, archives, formatting."""
