"""Batches, archives, caches and lifecycle on top of views."""
