"""Operators of the code graph."""
