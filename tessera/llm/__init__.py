"""Operators for building training corpora: filtering, near-duplicates, mixing, encoding.

Nothing outside this subpackage imports it; ``queries`` holds the thin contract
queries, every other module one operator with its own general interface.
"""
