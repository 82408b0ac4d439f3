"""Training-data operators: extraction, fingerprints, scans, scoring, deduplication, mixing and packing.

Nothing else in the library imports this subpackage.
"""
