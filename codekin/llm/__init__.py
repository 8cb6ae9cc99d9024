"""Operators for large training-data collections; nothing outside this package imports it."""
