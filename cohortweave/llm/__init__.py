"""Operators for training text, each on its own; nothing else in the library imports this package."""
