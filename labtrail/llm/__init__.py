"""Operators for preparing training data: search, filters, duplicates, mixing, archives, packing."""
