"""Spark-native curation of sequence alignments and large text corpora."""
