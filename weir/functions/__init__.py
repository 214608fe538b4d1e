"""Column-level building blocks: predicates, calendar parts, order buckets, aggregates."""
