"""Readers and writers of tab-separated files with JSON metadata."""
