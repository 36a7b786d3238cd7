"""Streaming of the alignment engine."""
