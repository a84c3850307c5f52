"""DataFrame operators: joins, prefix sums, estimators, metrics, ranking, retrieval."""
