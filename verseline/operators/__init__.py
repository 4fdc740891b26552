"""DataFrame operators: joins, ordered scans, aggregates, rankings and set operations."""
