"""Operators for training-corpus preparation; nothing else in the package imports them."""
