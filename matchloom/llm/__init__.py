"""Operators for building training corpora out of large document tables."""
