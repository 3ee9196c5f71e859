"""Operators for large training corpora; nothing outside imports this package."""
