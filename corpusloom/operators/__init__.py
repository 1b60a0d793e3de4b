"""DataFrame operators: ordering, joins, selection, splits, statistics, scores."""
