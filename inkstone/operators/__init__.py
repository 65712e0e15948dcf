"""DataFrame operators: joins, aggregations, windows and set operations."""
