"""Operators for training-data pipelines: extraction, duplicates, tokens, quality, privacy, sharding."""
