"""Training-data operators: similarity joins, packing, mixing, quality, deduplication.

Nothing else in the library imports this subpackage.
"""
