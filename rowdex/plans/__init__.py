"""Selections of positions and the views that turn them into DataFrame plans."""
