"""DataFrame operators: consensus, posts, ordering, sampling, metrics, joins, reports."""
