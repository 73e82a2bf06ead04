"""Plans of the code graph."""
