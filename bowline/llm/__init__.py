"""Training-data operators: packing, deduplication, filtering, tokens and archives.

Nothing else in the library imports this subpackage.
"""
