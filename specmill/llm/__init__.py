"""Operators for training-data pipelines: duplicates, filters, scans, search and packing."""
