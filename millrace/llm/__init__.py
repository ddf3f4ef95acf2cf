"""Operators for large training corpora: dedup, sharding, mixing, quality, packing, scans.

Nothing else in the library imports this subpackage.
"""
