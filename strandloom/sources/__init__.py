"""Sources of the alignment engine."""
