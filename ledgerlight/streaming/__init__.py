"""Streaming forms of counting, stateless detection and alert suppression."""
