"""Submit independent units of Spark work (grid cells, ensemble members, CV folds)
from a small thread pool, so their jobs run side by side on the cluster."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

# Units submitted at once.
PARALLEL_UNITS = 4


def run_parallel(items: list, fn, parallel: int | None = None) -> list:
    """``[fn(x) for x in items]`` with up to ``parallel`` at a time; order is kept."""
    workers = max(1, min(parallel or PARALLEL_UNITS, len(items)))
    if workers == 1:
        return [fn(x) for x in items]
    with ThreadPoolExecutor(max_workers=workers) as pool:
        return list(pool.map(fn, items))
