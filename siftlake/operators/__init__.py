"""Relational operators of deduplication."""
