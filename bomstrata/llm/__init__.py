"""Operators for text that people type and write, and for training corpora; nothing outside imports this package."""
