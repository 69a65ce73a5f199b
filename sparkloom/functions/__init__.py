"""The row language: predicates, calendar and numeric buckets, variant paths, row keys."""
