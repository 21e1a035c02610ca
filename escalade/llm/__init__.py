"""Operators for large-scale training data; nothing else in the library imports them."""
