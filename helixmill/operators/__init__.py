"""Relational operators over sequences, counts and sparse matrices."""
