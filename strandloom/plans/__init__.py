"""Plans of the alignment engine."""
