"""Scans, fixture mappings and sinks."""
