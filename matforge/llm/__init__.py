"""Operators of a training-data pipeline: filtering, scoring, de-duplication, extraction, search and packing."""
