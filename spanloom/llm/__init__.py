"""Operators for preparing training data: archives, vectors, text, packing."""
