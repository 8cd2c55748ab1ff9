"""Operators for text corpora: leaks, mixtures, languages.

Nothing outside this subpackage imports it.
"""
