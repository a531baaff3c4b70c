"""Training-data operators: search, dedup, decontamination, packing, scans, extraction and scoring.

Nothing else in the library imports this subpackage.
"""
