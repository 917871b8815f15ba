"""Operators for large-scale training data: scans, near-duplicates, packing, scoring.

Nothing else in the package imports this subpackage.
"""
