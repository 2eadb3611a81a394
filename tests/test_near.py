"""The preselection of near rows and the tiles it works on."""

import numpy as np
import pytest

from sparkpul.operators import knn as K
from sparkpul.operators.knn_quantised import tile_rows
from sparkpul.operators.near import near_pairs


def exact(q, p, ids, k):
    d = np.sqrt(((q[:, None] - p[None]) ** 2).sum(-1))
    return [sorted(range(len(p)), key=lambda j: (round(row[j], 9), ids[j]))[:k] for row in d]


def data(kind, rng):
    q, p = rng.normal(size=(70, 6)), rng.normal(size=(5000, 6))
    if kind == "outlier":
        p[7] = 1e7
    if kind == "close":
        q, p = 1 + 1e-6 * q, 1 + 1e-6 * p
    if kind == "large":
        q, p = 1e150 * q, 1e150 * p
    if kind == "crowd":
        p[1000:4000] = q[0]
    return q, p


@pytest.mark.parametrize("kind", ["plain", "outlier", "close", "large", "crowd"])
def test_nearest_rows_at_any_scale(kind):
    rng = np.random.default_rng(1)
    q, p = data(kind, rng)
    ids = rng.permutation(len(p))
    rows, cols, dist = (np.concatenate(x) for x in zip(*K._topk_in_steps(q, p, ids, 4)))
    want = exact(q, p, ids, 4)
    assert rows.tolist() == np.repeat(np.arange(70), 4).tolist()
    assert cols.reshape(70, 4).tolist() == want
    assert np.allclose(dist.reshape(70, 4), [np.sqrt(((p[w] - v) ** 2).sum(-1)) for v, w in zip(q, want)], rtol=1e-12)


def test_few_pairs_are_looked_at_exactly():
    rng = np.random.default_rng(2)
    q, p = rng.normal(size=(300, 32)), rng.normal(size=(9000, 32))
    assert sum(len(rows) for rows, _ in near_pairs(q, p, 3, 1e-9)) < 300 * 3 * 1.2


def test_tiles_of_a_side_are_bounded(spark, monkeypatch):
    """Tiles of 4 rows would be 125 a side; what is shuffled is bounded by the number of tiles."""
    assert tile_rows(64, 600_000, 1 << 15) == 18_750 and tile_rows(64, 357, 1 << 15) == 64
    assert tile_rows(64, 10**9, 1 << 15) == 1 << 15
    seen = []
    whole = K._knn_blocks
    monkeypatch.setattr(K, "_knn_blocks", lambda *a: seen.append(a[-1]) or whole(*a))
    x = np.random.default_rng(4).normal(size=(500, 3))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, features array<double>")
    got = {(r["id"], r["nn_rank"]): r["nn_id"] for r in
           K.knn_join(df, df, 2, "id", "id", method="blocks", block_rows=4, query_rows_per_group=4).collect()}
    assert max(seen[0]) <= 32
    assert got == {(i, n + 1): j for i, w in enumerate(exact(x, x, range(500), 2)) for n, j in enumerate(w)}


def test_pairs_beyond_the_known_reach_are_left_out():
    """No pair within both the k-th distance and the known reach is missed, and few others come."""
    rng = np.random.default_rng(5)
    q, p = rng.normal(size=(60, 16)) + 1e3, rng.normal(size=(7000, 16)) + 1e3
    d = np.sqrt(((q[:, None] - p[None]) ** 2).sum(-1))
    kth = np.sort(d, axis=1)[:, 4]
    within = kth * np.where(np.arange(60) % 3 == 0, 0.0, np.where(np.arange(60) % 3 == 1, 0.95, 2.0))
    got = {(i, j) for rows, cols in near_pairs(q, p, 5, 1e-9, within=within) for i, j in zip(rows.tolist(), cols.tolist())}
    want = {(i, j) for i, j in zip(*(x.tolist() for x in np.nonzero(d <= np.minimum(kth, within)[:, None])))}
    assert want <= got and len(got) < len(want) + 30
