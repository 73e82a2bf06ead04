"""Sources of the code graph."""
