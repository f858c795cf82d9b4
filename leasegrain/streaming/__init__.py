"""Incremental shaping of newly arrived raw responses."""
