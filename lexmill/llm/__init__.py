"""Training-data operators: deduplication, filtering, fingerprints and packing.

Nothing else in the library imports this subpackage.
"""
