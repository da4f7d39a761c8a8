"""Operators that prepare training data: filters, deduplication, packing, archives."""
