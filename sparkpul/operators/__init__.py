"""DataFrame operators: ranking, splits, kNN, metrics, detectors, result tables, statistics."""
