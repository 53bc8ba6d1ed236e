"""Readers and writers for files, vectors and derived tables."""
