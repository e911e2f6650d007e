"""Operators for building training data from text corpora; nothing else in the library imports this package."""
