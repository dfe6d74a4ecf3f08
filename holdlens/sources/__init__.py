"""Scans, sinks and the mapping of sample tables."""
