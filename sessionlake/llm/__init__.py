"""Operators for preparing session text as training data. Nothing outside this package imports it."""
