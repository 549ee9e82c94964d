"""Registered queries (Spark) and their independent DuckDB oracles."""
