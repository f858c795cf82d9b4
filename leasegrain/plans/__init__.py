"""Whole jobs, wired from operators."""
