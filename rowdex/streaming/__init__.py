"""Positions as a stream, and archives filled by streaming queries."""
