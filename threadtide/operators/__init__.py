"""DataFrame operators: selection, joins, ranking, summaries, distributions, tests, models."""
