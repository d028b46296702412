"""Operators for building training data from text; nothing else in the library imports this package."""
