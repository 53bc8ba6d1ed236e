"""Operators that prepare training data at scale: deduplication, filtering, extraction, mixing and packing."""
