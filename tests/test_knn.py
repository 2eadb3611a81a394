"""Exact kNN join against numpy brute force."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from sparkpul.operators.knn import credibility, knn_join
from tests.conftest import SF_SMALL


def _brute(q, qid, p, pid, k):
    d = np.sqrt(((q[:, None, :] - p[None, :, :]) ** 2).sum(-1))
    out = {}
    for i in range(len(q)):
        order = sorted(range(len(p)), key=lambda j: (round(d[i, j], 9), pid[j]))[:k]
        out[qid[i]] = [(pid[j], d[i, j]) for j in order]
    return out


@pytest.mark.parametrize("block_rows,per_group,method", [(1024, 4096, "blocks"), (16, 8, "blocks"), (1024, 4096, "broadcast"), (1024, 4096, "quantised"), (16, 8, "quantised")])
def test_knn_join_matches_brute_force(spark, block_rows, per_group, method):
    e = spark.read.parquet(f"{SF_SMALL}/embeddings.parquet")
    pdf = e.toPandas()
    vec = np.stack(pdf["embedding"].map(lambda v: np.asarray(v, dtype=np.float64)).to_numpy())
    ids = pdf["vec_id"].to_numpy()
    pos = pdf["label"].to_numpy() < 3
    q = e.where("label >= 3").withColumn("features", F.col("embedding").cast("array<double>"))
    r = e.where("label < 3").withColumn("features", F.col("embedding").cast("array<double>"))
    got = knn_join(q, r, 4, "vec_id", "vec_id", block_rows=block_rows, query_rows_per_group=per_group,
                   method=method).toPandas()
    exp = _brute(vec[~pos], ids[~pos], vec[pos], ids[pos], 4)
    assert got["vec_id"].nunique() == (~pos).sum()
    for qid, part in got.groupby("vec_id"):
        part = part.sort_values("nn_rank")
        assert part["nn_id"].tolist() == [a for a, _ in exp[qid]]
        assert np.allclose(part["distance"].to_numpy(), [b for _, b in exp[qid]], atol=1e-9)


def test_k_larger_than_reference_is_an_error(spark):
    df = spark.createDataFrame([(i, [float(i), 0.0]) for i in range(3)], "id long, features array<double>")
    with pytest.raises(ValueError):
        knn_join(df, df, 5, "id", "id")


@pytest.mark.parametrize("method", ["blocks", "broadcast", "quantised"])
def test_duplicate_vectors_tie_broken_by_id(spark, method):
    rows = [(1, [0.0, 0.0]), (3, [1.0, 1.0]), (2, [1.0, 1.0]), (4, [5.0, 5.0])]
    ref = spark.createDataFrame(rows, "id long, features array<double>")
    q = spark.createDataFrame([(10, [1.0, 1.0])], "id long, features array<double>")
    got = knn_join(q, ref, 2, "id", "id", method=method).toPandas().sort_values("nn_rank")
    assert got["nn_id"].tolist() == [2, 3]


def test_wide_tie_group_at_the_cut(spark):
    """More tied references than the candidate margin: the smallest ids still win."""
    rows = [(i, [1.0, 0.0]) for i in range(30, 0, -1)] + [(100, [0.0, 0.0])]
    ref = spark.createDataFrame(rows, "id long, features array<double>")
    q = spark.createDataFrame([(7, [0.0, 0.0])], "id long, features array<double>")
    got = knn_join(q, ref, 3, "id", "id", method="broadcast").toPandas().sort_values("nn_rank")
    assert got["nn_id"].tolist() == [100, 1, 2]


def test_credibility_counts_self(spark):
    rows = [(1, [0.0], 1), (2, [0.1], 0), (3, [10.0], 0), (4, [10.1], 0)]
    df = spark.createDataFrame(rows, "id long, features array<double>, y_pu int")
    got = {r["id"]: r["credibility"] for r in credibility(df, 2, "id").collect()}
    assert got == {2: 0.5, 3: 0.0, 4: 0.0}


def test_plans_agree_with_small_tiles(spark, monkeypatch):
    from sparkpul.operators import knn as K

    monkeypatch.setattr(K, "TASK_MATRIX_CELLS", 50)
    e = spark.read.parquet(f"{SF_SMALL}/embeddings.parquet").withColumn("features", F.col("embedding").cast("array<double>"))
    q, r = e.where("label >= 5"), e.where("label < 5")
    a = {(x["vec_id"], x["nn_rank"]): x["nn_id"] for x in knn_join(q, r, 3, "vec_id", "vec_id", method="broadcast").collect()}
    b = {(x["vec_id"], x["nn_rank"]): x["nn_id"] for x in
         knn_join(q, r, 3, "vec_id", "vec_id", method="blocks", block_rows=8).collect()}
    assert a == b


@pytest.mark.parametrize("method", ["blocks", "broadcast", "quantised"])
def test_far_offset_and_near_duplicates(spark, method):
    """Vectors a million away from the origin that differ in the sixth digit."""
    rng = np.random.default_rng(4)
    p = 1e6 + rng.normal(size=(300, 16))
    p[100:200] = p[:100] + rng.normal(scale=1e-6, size=(100, 16))
    q = p[rng.permutation(300)[:80]] + rng.normal(scale=1e-6, size=(80, 16))
    frame = lambda x: spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, features array<double>")
    got = knn_join(frame(q), frame(p), 5, "id", "id", method=method, block_rows=64, query_rows_per_group=32).toPandas()
    exp = _brute(q, range(80), p, range(300), 5)
    for qid, part in got.groupby("id"):
        assert part.sort_values("nn_rank")["nn_id"].tolist() == [a for a, _ in exp[qid]]


@pytest.mark.parametrize("bad", [None, [1.0], [1.0, None]])
def test_bad_vectors_fail_with_a_message(spark, bad):
    ref = spark.createDataFrame([(i, [float(i), 0.0]) for i in range(5)], "id long, features array<double>")
    q = spark.createDataFrame([(1, bad)], "id long, features array<double>")
    with pytest.raises(Exception, match="query vector"):
        knn_join(q, ref, 2, "id", "id").collect()


def test_mean_distance_in_both_plans(spark):
    from sparkpul.operators.knn import mean_knn_distance

    e = spark.read.parquet(f"{SF_SMALL}/embeddings.parquet").withColumn("features", F.col("embedding").cast("array<double>"))
    q, r = e.where("label >= 5"), e.where("label < 5")
    a, b = (
        {x["vec_id"]: x["mean_dist"] for x in mean_knn_distance(q, r, 3, "vec_id", method=m).collect()} for m in ("broadcast", "blocks")
    )
    assert a.keys() == b.keys() and all(abs(a[i] - b[i]) < 1e-12 for i in a)


def _frame(spark, x, ids=None):
    return spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(range(len(x)) if ids is None else ids, x)], "id long, features array<double>")


def test_quantised_bounds_hold():
    """Every distance lies between its bounds, outside the grid and at its edges too."""
    from sparkpul.operators.knn_quantised import Grid

    rng = np.random.default_rng(2)
    r = rng.normal(size=(60, 7)) * [1, 1e-6, 1e6, 1, 0, 3, 1]
    q = np.concatenate([rng.normal(size=(20, 7)) * 5, r[:10], r.max(axis=0, keepdims=True), r.min(axis=0, keepdims=True)])
    grid = Grid(r.min(axis=0), r.max(axis=0))
    lower, upper = grid.bounds(*grid.codes(q), *grid.codes(r))
    d = np.sqrt(((q[:, None] - r[None]) ** 2).sum(-1))
    assert (lower <= d).all() and (d <= upper).all()


def _survivors(spark, q, r, k, tile_rows):
    from sparkpul.operators import knn as K
    from sparkpul.operators.knn_quantised import candidates

    qd, refd, n_ref, dim, _ = K._sides(_frame(spark, q), _frame(spark, r), k, "id", "id", "features", "features", [], "quantised")
    return candidates(qd, refd, k, n_ref, dim, tile_rows)[0].count()


def test_quantised_compares_few_pairs(spark):
    """The share of exact distances: spread vectors and clusters far apart."""
    rng = np.random.default_rng(3)
    q, r = rng.normal(size=(150, 32)), rng.normal(size=(900, 32))
    assert 150 * 4 <= _survivors(spark, q, r, 4, 128) < 0.02 * 150 * 900
    middle = 50 * rng.normal(size=(9, 32))
    q, r = q + middle[rng.integers(0, 9, 150)], r + middle[rng.integers(0, 9, 900)]
    got = {(x["id"], x["nn_rank"]): x["nn_id"] for x in
           knn_join(_frame(spark, q), _frame(spark, r), 4, "id", "id", method="quantised", block_rows=64).collect()}
    want = _brute(q, range(150), r, range(900), 4)
    assert got == {(i, n + 1): j for i, found in want.items() for n, (j, _) in enumerate(found)}


def test_quantised_with_a_crowded_vector(spark):
    """A third of the reference is one vector: its least ids win, and it does not multiply."""
    rng = np.random.default_rng(8)
    r = np.concatenate([np.tile([[0.5, 0.5, 0.5]], (300, 1)), rng.normal(size=(600, 3))])
    ids = rng.permutation(900)
    q = np.concatenate([rng.normal(size=(40, 3)), [[0.5, 0.5, 0.5]]])
    got = knn_join(_frame(spark, q), _frame(spark, r, ids), 6, "id", "id", method="quantised", block_rows=100).toPandas()
    want = _brute(q, range(41), r, ids, 6)
    for i, part in got.groupby("id"):
        assert part.sort_values("nn_rank")["nn_id"].tolist() == [j for j, _ in want[i]]
    # cells of up to 300 rows, of which the crowd gives 6
    assert _survivors(spark, q, r, 6, 100) < 41 * 60


def test_quantised_carries_columns(spark):
    ref = spark.createDataFrame([(i, [float(i), 1.0], f"name {i}", None) for i in range(9)], "id long, features array<double>, a string, b int")
    q = spark.createDataFrame([(3, [2.2, 1.0])], "id long, features array<double>")
    got = knn_join(q, ref, 2, "id", "id", carry=["a", "b"], method="quantised").orderBy("nn_rank").collect()
    assert [(r["id"], r["nn_id"], r["a"], r["b"]) for r in got] == [(3, 2, "name 2", None), (3, 3, "name 3", None)]
    assert knn_join(q.limit(0), ref, 2, "id", "id", method="quantised").collect() == []


def test_quantised_asks_hardly_more_than_the_nearest(spark):
    """Spread vectors of 64 dimensions: next to no row but the k nearest is joined with its vector."""
    rng = np.random.default_rng(11)
    q, r = rng.normal(size=(200, 64)), rng.normal(size=(2000, 64))
    assert 200 * 6 <= _survivors(spark, q, r, 6, 64) < 200 * 6 * 1.05


def test_quantised_lanes_of_cells(spark):
    """Many cells a lane, of which queries are to meet some; one cell larger than a lane."""
    from sparkpul.operators.knn_quantised import LANE_CELLS, _lanes

    sizes = np.array([5, 90, 3, 0, 4] + [1] * 40)
    lane, place = _lanes(sizes, np.arange(45.0)[:, None], 40)
    assert len(set(zip(lane, place))) == 45 and place.max() < LANE_CELLS
    assert all((lane == i).sum() == 1 or sizes[lane == i].sum() <= 40 for i in lane)
    rng = np.random.default_rng(12)
    middle = 30 * rng.normal(size=(40, 2))
    r = np.concatenate([rng.normal(size=(600, 2)) * 0.01, rng.normal(size=(900, 2)) + middle[rng.integers(0, 40, 900)]])
    q = np.concatenate([rng.normal(size=(40, 2)) * 0.01, rng.normal(size=(80, 2)) + middle[rng.integers(0, 40, 80)]])
    got = {(x["id"], x["nn_rank"]): x["nn_id"] for x in
           knn_join(_frame(spark, q), _frame(spark, r), 5, "id", "id", method="quantised", block_rows=16).collect()}
    want = _brute(q, range(120), r, range(1500), 5)
    assert got == {(i, n + 1): j for i, found in want.items() for n, (j, _) in enumerate(found)}


def test_credibility_asks_unlabeled_rows_only(spark, monkeypatch):
    from sparkpul.operators import knn as K

    seen, whole = [], K.knn_join
    monkeypatch.setattr(K, "knn_join", lambda q, *a, **kw: seen.append(q.count()) or whole(q, *a, **kw))
    rows = [(i, [float(i * i % 17), float(i)], int(i % 3 == 0)) for i in range(30)] + [(None, [1.0, 1.0], 0)]
    df = spark.createDataFrame(rows, "id long, features array<double>, y_pu int")
    got = {x["id"]: x["credibility"] for x in credibility(df, 1, "id").collect()}
    assert seen == [20] and got == {i: 0.0 for i in range(30) if i % 3}
