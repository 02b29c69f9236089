"""Readers of session histories."""
