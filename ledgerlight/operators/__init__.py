"""Operators: quality, cleaning, enrichment, profiles, features, detectors, fusion and reports."""
