"""Operators of a training-data pipeline: tokens, filters, near copies, search and packing.

Nothing else in the library imports this package.
"""
