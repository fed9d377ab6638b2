"""Operators for training-data pipelines: deduplication, sketches, tokens, classifiers, search and packing."""
