"""Operators of the alignment engine."""
