"""Operators for training data: scoring, extraction, near-duplicates, search, packing.

Nothing else in the library imports this subpackage.
"""
