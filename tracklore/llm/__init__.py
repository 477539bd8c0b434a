"""Operators for training-data pipelines: secrets, tokens, deduplication, packing, quality, search.

Nothing outside this folder, its tests and corpus_pipeline.py imports it.
"""
