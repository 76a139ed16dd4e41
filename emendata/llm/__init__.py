"""Operators for large training-data pipelines (packing, fingerprints, extraction, ...)."""
