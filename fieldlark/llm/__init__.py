"""Operators for large text corpora (fingerprints, packing, filters, dedup, ...).

Nothing else in the library imports this subpackage.
"""
