"""Newton's method for many linear models at once over one table.

All members share the rows and differ in labels and row weights. A pass over the blocks
gives every member its loss, gradient and Gram matrix at its present weights, added up
per task, and the driver solves one small system per member: one Spark job per Newton
step, however many members there are. A step that raises a member's loss is halved.

Objective of a member: ``sum(penalty * w^2) / 2 + C * sum(weight * loss)``.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .blocks import add_up, unpack

#: bytes of Gram matrices that a task holds; more members take turns
GRAM_BYTES = 64 << 20


def logistic(z: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Log loss with labels (or soft targets) ``y``, slope and curvature in ``z``."""
    p = 1 / (1 + np.exp(-np.clip(z, -700, 700)))
    return np.logaddexp(0, z) - y * z, p - y, p * (1 - p)


def squared_hinge(z: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``max(0, 1 - s z)^2`` with ``s`` = 1 or -1 for labels 1 and 0; rows beyond the
    margin have neither slope nor curvature."""
    s = 2 * y - 1
    short = np.maximum(0, 1 - s * z)
    return short * short, -2 * s * short, 2.0 * (short > 0)


LOSSES = {"logistic": logistic, "squared_hinge": squared_hinge}


def solve(gram: np.ndarray, slope: np.ndarray) -> np.ndarray:
    """The Newton step; of least length where the Gram matrix is singular."""
    try:
        return np.linalg.solve(gram, slope)
    except np.linalg.LinAlgError:
        return np.linalg.lstsq(gram, slope, rcond=None)[0]


@dataclass
class Fit:
    """Weights (members x features, intercept last), label sums and passes of a fit."""

    weights: np.ndarray
    positives: np.ndarray
    rows: np.ndarray
    passes: int


def fit(
    blocks: DataFrame,
    members: int,
    loss: str = "logistic",
    C: float = 1.0,
    penalize_intercept: bool = False,
    penalty: float = 1.0,
    weighted: bool = False,
    tolerance: float = 1e-7,
    max_passes: int = 100,
) -> Fit:
    """Fit ``members`` models to blocks of ``x``, ``y`` (a column per member) and, if
    ``weighted``, ``w`` (row weights per member). ``max_passes`` bounds the passes of a turn."""
    names = ["x", "y", "w"] if weighted else ["x", "y"]
    head = blocks.select("n", "x").first()
    if head is None:
        raise ValueError("no rows to fit")
    dim = len(head["x"]) // (8 * head["n"]) + 1
    pen = np.full(dim, float(penalty))
    pen[-1] = pen[-1] if penalize_intercept else 0.0
    tasks = blocks.rdd.getNumPartitions()
    turn = max(1, min(members, GRAM_BYTES // (8 * dim * dim)))
    size = 8 * (3 + dim + dim * dim)
    weights, sums, passes = np.zeros((members, dim)), np.zeros((members, 2)), 0

    def gather(active: list[int], at: np.ndarray) -> dict[int, np.ndarray]:
        measure = LOSSES[loss]

        def run(batches):
            total = np.zeros((len(active), 3 + dim + dim * dim))
            for batch in batches:
                for n, *values in unpack(batch, names):
                    x = np.hstack([values[0], np.ones((n, 1))])
                    y = values[1][:, active]
                    value, slope, curve = measure(x @ at.T, y)
                    if weighted:
                        w = values[2][:, active]
                        value, slope, curve, y, ones = value * w, slope * w, curve * w, y * w, w
                    else:
                        ones = np.ones_like(y)
                    total[:, 0] += value.sum(axis=0)
                    total[:, 1] += y.sum(axis=0)
                    total[:, 2] += ones.sum(axis=0)
                    total[:, 3 : 3 + dim] += slope.T @ x
                    for j in range(len(active)):
                        total[j, 3 + dim :] += ((x * curve[:, j : j + 1]).T @ x).ravel()
            yield pa.RecordBatch.from_arrays(
                [pa.array(active, pa.int32()), pa.array([t.tobytes() for t in total], pa.binary())], ["member", "sums"]
            )

        parts = blocks.select("n", *names).mapInArrow(run, "member int, sums binary")
        return dict(add_up(parts, tasks, "member", "sums", size * len(active)))

    for first in range(0, members, turn):
        active = list(range(first, min(first + turn, members)))
        base, step = {}, {}  # accepted weights, and the step tried from there
        best = dict.fromkeys(active, np.inf)
        for _ in range(max_passes):
            passes += 1
            found = gather(active, weights[active])
            going = []
            for j in active:
                t, w = found[j], weights[j]
                sums[j] = t[1:3]
                value = C * t[0] + (pen * w * w).sum() / 2
                if value > best[j] + 1e-12 * abs(best[j]):
                    step[j] = step[j] / 2
                else:
                    slope = C * t[3 : 3 + dim] + pen * w
                    gram = C * t[3 + dim :].reshape(dim, dim) + np.diag(pen)
                    best[j], base[j] = value, w.copy()
                    step[j] = -solve(gram, slope)
                weights[j] = base[j] + step[j]
                constant = loss == "logistic" and not penalize_intercept and sums[j, 0] in (0.0, sums[j, 1])
                if constant:  # one class alone: no finite intercept
                    weights[j] = 0.0
                    weights[j, -1] = np.inf if sums[j, 0] else -np.inf
                elif np.abs(step[j]).max() > tolerance:
                    going.append(j)
            active = going
            if not active:
                break
    return Fit(weights, sums[:, 0], sums[:, 1], passes)
