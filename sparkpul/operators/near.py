"""Pairs of near rows of two matrices, the inner step of every kNN plan.

Distances are taken in the matrix form ``|a|^2 + |b|^2 - 2 a.b`` in single precision, which
only preselects: rows are moved by the mean of ``b`` and scaled first, and the bound of the
form's rounding error is added to every limit. The first columns give a limit per row; of
the others only the entries within it are looked at again. Where single precision is too
rough for the data, the same is done in double precision.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: columns of a distance matrix computed at once, and its entries
STEP_COLUMNS, STEP_CELLS = 4096, 1 << 22
#: columns that give the first limit, at least
FIRST_COLUMNS = 2048
#: entries per row, times k, from which double precision is tried
CROWD = 64


def _near(
    a: np.ndarray, aa: np.ndarray, b: np.ndarray, bb_max: float, k: int, room: np.ndarray, many: float, within: np.ndarray
):
    """Rows, columns of the entries that may be within the k-th least distance plus ``room``
    and within ``within``; None if there are more than ``many``. ``a`` is ``[-2 a, 1]``,
    ``b`` is ``[b, |b|^2]``."""
    error = 4 * (a.shape[1] + 8) * float(np.finfo(a.dtype).eps) * (aa + bb_max) + float(np.finfo(np.float32).tiny) * a.shape[1]

    def limit(kth: np.ndarray) -> np.ndarray:
        return (np.sqrt(np.maximum(kth + aa + error, 0)) + room) ** 2 + error - aa

    first = min(len(b), max(FIRST_COLUMNS, 4 * k))
    rows, cols, values, found, reach = [], [], [], 0, None
    for at in [0, *range(first, len(b), STEP_COLUMNS)]:
        part = b[at : first if at == 0 else at + STEP_COLUMNS]
        g = a @ part.T
        if reach is None:
            reach = limit(np.partition(g, k - 1, axis=1)[:, k - 1].astype(np.float64))
            reach = np.minimum(reach, within**2 + error - aa)
            low = reach.astype(a.dtype)
            low = np.where(low < reach, np.nextafter(low, np.asarray(np.inf, a.dtype)), low)[:, None]
        hits = np.flatnonzero((g <= low).ravel())
        found += len(hits)
        if found > many:
            return None
        rows.append(hits // len(part))
        cols.append(hits % len(part) + at)
        values.append(g.ravel()[hits])
    rows, cols, values = np.concatenate(rows), np.concatenate(cols), np.concatenate(values).astype(np.float64)
    order = np.lexsort((values, rows))
    rows, cols, values = rows[order], cols[order], values[order]
    start, end = (np.searchsorted(rows, np.arange(len(a)), side) for side in ("left", "right"))
    full, kth = end - start >= k, np.full(len(a), np.inf)
    kth[full] = values[start[full] + k - 1]
    kept = values <= limit(kth)[rows]
    return rows[kept], cols[kept]


def near_pairs(
    a: np.ndarray, b: np.ndarray, k: int, room: np.ndarray | float, cells: int = STEP_CELLS,
    within: np.ndarray | float = np.inf,
) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows of ``a`` and of ``b``, slice by slice of ``a``, row after row: all pairs whose
    distance is at most the row's k-th least distance plus ``room``, and few others. Pairs
    farther apart than ``within`` may be left out."""
    room, within = (np.broadcast_to(np.asarray(x, np.float64), (len(a),)) for x in (room, within))
    middle = b.mean(axis=0) if len(b) else 0.0
    a, b = a - middle, b - middle
    scale = max(np.abs(a).max(initial=0.0), np.abs(b).max(initial=0.0)) or 1.0
    if k >= len(b) or not np.isfinite(scale):
        step = max(1, cells // (8 * max(1, len(b))))
        for at in range(0, len(a), step):
            n = min(step, len(a) - at)
            yield np.repeat(np.arange(at, at + n), len(b)), np.tile(np.arange(len(b)), n)
        return
    a, b, room, within = a / scale, b / scale, room / scale, within / scale
    aa, bb = np.einsum("ij,ij->i", a, a), np.einsum("ij,ij->i", b, b)
    whole = np.concatenate([b, bb[:, None]], axis=1)
    rough = whole.astype(np.float32)

    def ask(at: int, end: int, columns: np.ndarray, many: float):
        rows = np.concatenate([-2 * a[at:end], np.ones((end - at, 1))], axis=1).astype(columns.dtype)
        return _near(rows, aa[at:end], columns, bb.max(), k, room[at:end], many, within[at:end])

    step = max(1, cells // min(len(b), STEP_COLUMNS))
    for at in range(0, len(a), step):
        end = min(len(a), at + step)
        found = ask(at, end, rough, CROWD * k * (end - at))
        if found is not None:
            yield found[0] + at, found[1]
            continue
        small = max(1, step // 8)
        for low in range(at, end, small):
            found = ask(low, min(end, low + small), whole, float("inf"))
            yield found[0] + low, found[1]
