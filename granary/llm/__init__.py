"""Operators for building training corpora: tokenizing, deduplicating, scoring, packing and extracting documents.

Each module holds one operator with its own interface; ``queries`` registers one query for each. Nothing outside this
folder imports it.
"""
