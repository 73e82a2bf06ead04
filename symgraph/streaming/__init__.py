"""Streaming of the code graph."""
