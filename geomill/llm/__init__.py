"""Operators for large text and embedding corpora."""
