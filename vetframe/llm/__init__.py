"""Operators for building training corpora: deduplication, filtering, detection, packing.

Nothing else in the library imports this subpackage.
"""
