"""DataFrame operators: patterns, windows, buckets, rules, registry, access."""
