"""Training-data operators: deduplication, scoring, tokenisation, packing, archives.

Nothing else in the library imports this subpackage.
"""
