"""Operators for preparing training data: selection, deduplication, scans, archives, mixing and packing."""
