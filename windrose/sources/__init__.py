"""Readers of benchmark files and writers of results."""
