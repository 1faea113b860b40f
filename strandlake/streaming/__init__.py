"""Incremental statistics."""
