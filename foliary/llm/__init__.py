"""Training-data operators: extraction, deduplication, filtering, mixing, tokenizing.

Nothing else in the library imports this subpackage.
"""
