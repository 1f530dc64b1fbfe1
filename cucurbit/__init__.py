"""Molecular fingerprint analytics on Spark: sources, sparse vectors, similarity, losses, embedding."""
