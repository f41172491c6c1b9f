"""Training-data operators: tokenising, search, quality, packing, deduplication, extraction, PII.

Nothing else in the library imports this subpackage.
"""
