"""Operators for large text collections: duplicates, contamination, languages, tokens, packing, search."""
