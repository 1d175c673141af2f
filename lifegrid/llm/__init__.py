"""Operators for building training corpora: filtering, dedup, tokens, mixing, search.

Nothing else in the library imports this subpackage.
"""
