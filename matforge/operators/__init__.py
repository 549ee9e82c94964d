"""DataFrame -> DataFrame operators (joins, aggregates, windows, composite jobs)."""
