"""Scans, catalogue, sinks and the views over the driver tables."""
