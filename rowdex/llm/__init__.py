"""Operators for preparing language-model training text.

Nothing outside this package imports it; the package can be removed without
touching the positional access layer.
"""
