"""Operators for large text corpora, each by its own method; nothing else in the library imports them."""
