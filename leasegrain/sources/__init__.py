"""Readers and writers for raw responses and the small bookkeeping tables."""
