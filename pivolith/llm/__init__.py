"""Training-data operators: filters, deduplication, extraction, tokenising, packing.

Nothing else in the library imports this subpackage.
"""
