"""Operators for training-data pipelines: tokens, quality, deduplication, fingerprints, mixing, chat formatting.

Nothing else in the library imports this subpackage.
"""
