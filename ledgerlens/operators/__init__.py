"""Row-level operators: selectors, joins, ranking, evaluation."""
