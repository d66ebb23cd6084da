"""DataFrame operators: rules, dedup, numbering, joins, top-k."""
