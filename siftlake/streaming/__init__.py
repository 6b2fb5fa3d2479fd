"""Deduplication of streams."""
