"""Metrics against hand-computed values and the brute-force pair formula."""

import math

import numpy as np
import pandas as pd
import pytest

from sparkpul.operators import metrics as M


def _df(spark, y, s):
    return spark.createDataFrame(pd.DataFrame({"y": np.asarray(y, dtype=np.int64), "s": np.asarray(s, dtype=float)}))


def brute_aul(y, s):
    y, s = np.asarray(y), np.asarray(s, dtype=float)
    acc = 0.0
    for a in s[y == 1]:
        for b in s:
            acc += 1.0 if a > b else (0.0 if a < b else 0.5)
    return acc / ((y == 1).sum() * len(y))


def test_aul_perfect_ranking(spark):
    assert M.aul(_df(spark, [1, 1, 0, 0], [0.9, 0.8, 0.2, 0.1]), "y", "s").first()["aul"] == pytest.approx(0.75)


def test_aul_all_equal_is_half(spark):
    assert M.aul(_df(spark, [1, 0, 1, 0, 0], [0.3] * 5), "y", "s").first()["aul"] == pytest.approx(0.5)


def test_aul_matches_brute_force(spark):
    rng = np.random.default_rng(1)
    y = rng.integers(0, 2, 300)
    s = rng.integers(0, 20, 300) / 20.0
    assert M.aul(_df(spark, y, s), "y", "s").first()["aul"] == pytest.approx(brute_aul(y, s), abs=1e-12)


def test_aul_hard_prediction_identity(spark):
    """AUL on hard predictions = pi/2 + (1 - pi) * balanced accuracy."""
    rng = np.random.default_rng(2)
    y = rng.integers(0, 2, 500)
    p = np.where(rng.random(500) < 0.7, y, 1 - y)
    df = _df(spark, y, p)
    a = M.aul(df, "y", "s").first()["aul"]
    ba = M.classification_metrics(df, "y", "s").first()["balanced_accuracy"]
    pi = y.mean()
    assert a == pytest.approx(pi / 2 + (1 - pi) * ba, abs=1e-12)


def test_lift_curve_all_equal(spark):
    pts = M.lift_curve(_df(spark, [1, 0, 1], [0.5] * 3), "y", "s", expand=True).toPandas().sort_values("pos")
    assert pts[["y_rate", "tpr"]].values.tolist() == [[1.0, 1.0], [0.0, 0.0], [0.0, 0.0], [0.0, 0.0]]


def test_lift_curve_matches_loop(spark):
    rng = np.random.default_rng(4)
    y = rng.integers(0, 2, 50)
    s = rng.integers(0, 10, 50).astype(float)
    pts = M.lift_curve(_df(spark, y, s), "y", "s", expand=True).toPandas().sort_values("pos")
    order = np.argsort(s, kind="stable")
    ss, yy = s[order], y[order]
    xs, ys = [1.0], [1.0]
    for t in ss:
        above = ss > t
        xs.append(above.sum() / len(ss))
        ys.append((above & (yy == 1)).sum() / (yy == 1).sum())
    assert np.allclose(pts["y_rate"], xs) and np.allclose(pts["tpr"], ys)


def test_pu_f1_above_one_and_null(spark):
    r = M.pu_f1(_df(spark, [1, 1, 0, 0], [1, 1, 0, 0]), "y", "s").first()
    assert r["pu_f1"] == pytest.approx(2.0)
    assert M.pu_f1(_df(spark, [1, 0], [0, 0]), "y", "s").first()["pu_f1"] is None


def test_balanced_accuracy_one_class(spark):
    r = M.classification_metrics(_df(spark, [1, 1, 1, 1], [1, 0, 1, 1]), "y", "s").first()
    assert r["balanced_accuracy"] == pytest.approx(0.75)
    assert r["f1"] == pytest.approx(2 * 3 / (2 * 3 + 1))


def test_nnpu_risk_formula(spark):
    y = [1, 1, 0, 0, 0]
    p = [0.9, 0.6, 0.2, 0.7, 0.4]
    r = M.nnpu_risk(_df(spark, y, p), "y", "s", 0.4).first()
    pp = np.mean([-math.log(0.9), -math.log(0.6)])
    pn = np.mean([-math.log(0.1), -math.log(0.4)])
    un = np.mean([-math.log(0.8), -math.log(0.3), -math.log(0.6)])
    assert r["nnpu_risk"] == pytest.approx(0.4 * pp + max(0.0, un - 0.4 * pn))


def test_lift_curve_expand_in_chunks(spark, monkeypatch):
    monkeypatch.setattr(M, "EXPAND_CHUNK", 3)
    y = [1, 0, 0, 1, 0, 0, 0, 1]
    s = [0.5, 0.5, 0.5, 0.5, 0.5, 0.9, 0.1, 0.5]
    pts = M.lift_curve(_df(spark, y, s), "y", "s", expand=True).toPandas().sort_values("pos")
    assert pts["pos"].tolist() == list(range(0, 9))
    loop = M.lift_curve(_df(spark, y, s), "y", "s").toPandas()
    assert loop["n_points"].sum() == 9


def test_aul_binary_equals_aul(spark):
    rng = np.random.default_rng(7)
    y = rng.integers(0, 2, 200)
    p = rng.integers(0, 2, 200)
    df = _df(spark, y, p)
    assert M.aul_binary(df, "y", "s").first()["aul"] == pytest.approx(M.aul(df, "y", "s").first()["aul"], abs=1e-12)


@pytest.mark.parametrize("rows_per_bucket", [1 << 20, 40])
@pytest.mark.parametrize("keys", [(), ("g",)])
def test_lift_curve_reads_the_scores_once(spark, monkeypatch, rows_per_bucket, keys):
    """Counts from below and from above come from one read, in one bucket and in many."""
    from sparkpul.operators import ranking as K

    monkeypatch.setattr(K, "ROWS_PER_BUCKET", rows_per_bucket)
    rng = np.random.default_rng(5)
    rows = [(int(g), int(rng.random() < 0.3), float(s)) for g, s in zip(rng.integers(0, 3, 400), rng.integers(0, 90, 400) / 7)]
    reads = spark.sparkContext.accumulator(0)

    def counting(batches):
        for b in batches:
            reads.add(len(b))
            yield b

    df = spark.createDataFrame(rows, "g int, y int, s double").mapInPandas(counting, "g int, y int, s double")
    got = M.lift_curve(df, "y", "s", keys).collect()
    assert reads.value == 400
    groups = sorted({r[0] for r in rows}) if keys else [None]
    want = []
    for g in groups:
        part = [r for r in rows if g is None or r[0] == g]
        n, p = len(part), sum(r[1] for r in part)
        want.append((g, None, 1, 0, 1.0, 1.0))
        for s in sorted({r[2] for r in part}):
            same, above = [r for r in part if r[2] == s], [r for r in part if r[2] > s]
            below = n - len(same) - len(above)
            want.append((g, s, len(same), below + 1, len(above) / n, sum(r[1] for r in above) / p))
    found = [((r["g"],) if keys else (None,)) + (r["score"], r["n_points"], r["first_pos"], r["y_rate"], r["tpr"]) for r in got]
    assert sorted(found, key=str) == sorted(want, key=str)


def test_lift_curve_empty(spark):
    none = spark.createDataFrame([], "g int, y int, s double")
    assert [r["first_pos"] for r in M.lift_curve(none, "y", "s").collect()] == [0]
    assert M.lift_curve(none, "y", "s", ["g"]).collect() == []
