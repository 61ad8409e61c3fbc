"""Readers and writers of sequence files and run results."""
