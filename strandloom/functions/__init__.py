"""Functions of the alignment engine."""
