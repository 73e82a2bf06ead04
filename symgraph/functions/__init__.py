"""Functions of the code graph."""
