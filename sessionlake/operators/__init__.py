"""Operators that scan and aggregate the relational session tables."""
