"""Result-table operators: pivots (including the flattened tuple names of a pivot over
several axes), quantiles, zips and widening."""

import numpy as np
import pandas as pd
import pytest

from sparkpul.operators import results as R


def test_flat_pivot_names_and_values(spark):
    rows = [("b32", 5.386517, "logistic", "knn", 0.61), ("b32", 5.386517, "logistic", "k-means", 0.55),
            ("l14", 5.386517, "logistic", "knn", 0.62), ("l14", 6.129032, "svm", "knn", 0.71)]
    df = spark.createDataFrame(rows, "extractor string, threshold double, classifier string, detector string, v double")
    wide = R.pivot_results(df, "extractor", ["threshold", "classifier", "detector"], "v").toPandas().set_index("extractor")
    assert set(wide.columns) == {"(5.386517, 'logistic', 'knn')", "(5.386517, 'logistic', 'k-means')",
                                 "(6.129032, 'svm', 'knn')"}
    assert wide.loc["l14", "(6.129032, 'svm', 'knn')"] == pytest.approx(0.71)
    assert pd.isna(wide.loc["b32", "(6.129032, 'svm', 'knn')"])


def test_pivot_duplicate_keys_raise(spark):
    df = spark.createDataFrame([("a", "x", 1.0), ("a", "x", 2.0)], "m string, d string, v double")
    with pytest.raises(ValueError):
        R.pivot_results(df, "m", "d", "v")


def test_exact_quantiles_match_numpy(spark):
    rng = np.random.default_rng(0)
    x = rng.integers(0, 50, 401).astype(float)
    df = spark.createDataFrame(pd.DataFrame({"x": x}))
    probs = [0.5, 0.55, 0.9, 0.99]
    got = {r["prob"]: r["threshold"] for r in R.exact_quantiles(df, "x", probs).collect()}
    for p in probs:
        assert got[p] == pytest.approx(float(np.quantile(x, p)))


def test_zip_axes_truncates(spark):
    z = R.zip_axes(spark, a=[1, 2, 3], b=["x", "y"])
    assert z.count() == 2


def test_widen_and_unique_columns(spark):
    a = spark.createDataFrame([("l", 0.5, 1)], "classifier string, metric double, n long")
    b = spark.createDataFrame([("l", 0.7, 2)], "classifier string, metric double, n long")
    w = R.widen_by_setting({"s1": a, "s2": b}, "classifier", ["metric"])
    assert set(w.columns) >= {"classifier", "metric_s1", "metric_s2"}
    assert R.unique_columns(["a", "b", "a"]) == ["a", "b"]


def test_quantiles_by_sketch_and_exact_scan(spark):
    """Coarse sketches, ties across brackets, tiny tables: always numpy's quantiles."""
    rng = np.random.default_rng(4)
    probs = [0.0, 0.001, 0.25, 0.5, 0.55, 0.9, 0.999, 1.0]
    cases = [rng.normal(size=3000), rng.integers(0, 7, 2500).astype(float), np.full(800, 3.0), np.array([1.0]),
             np.concatenate([np.full(1500, -1.0), rng.normal(size=700), [np.inf, -np.inf]])]
    for x in cases:
        df = spark.createDataFrame([(float(v),) for v in x] + [(None,), (float("nan"),)], "v double").repartition(6)
        for accuracy in (20, 10_000):
            got = {r["prob"]: r["threshold"] for r in R.exact_quantiles(df, "v", probs, accuracy).collect()}
            want = dict(zip(probs, np.quantile(x, probs)))
            for p in probs:
                assert got[p] == pytest.approx(want[p], abs=1e-12, nan_ok=True)
    none = spark.createDataFrame([], "v double")
    assert [r["threshold"] for r in R.exact_quantiles(none, "v", [0.5]).collect()] == [None]
    assert R.exact_quantiles(none, "v", []).collect() == []


def test_a_bracket_that_misses_is_mended(spark, monkeypatch):
    """Should the sketch be wrong, every value is counted."""
    counted = R._counted
    calls = []

    def wrong(vals, brackets):
        calls.append(brackets)
        return counted(vals, [(1e9, 2e9)] if len(calls) == 1 else brackets)

    monkeypatch.setattr(R, "_counted", wrong)
    x = np.arange(100.0)
    df = spark.createDataFrame([(float(v),) for v in x], "v double")
    assert [r["threshold"] for r in R.exact_quantiles(df, "v", [0.3]).collect()] == [pytest.approx(np.quantile(x, 0.3))]
    assert len(calls) == 2


def test_quantiles_read_the_table_twice(spark, tmp_path):
    """Two scans of the data; the second shuffles only what lies in the brackets."""
    spark.range(20000).selectExpr("CAST(id AS DOUBLE) AS v").write.parquet(str(tmp_path / "t"))
    counted = R._counted(spark.read.parquet(str(tmp_path / "t")), [(9990.0, 10010.0)]).collect()
    assert len(counted) == 21 + 2 and sum(r["cnt"] for r in counted) == 20000
    reads = spark.sparkContext.accumulator(0)

    def counting(batches):
        for b in batches:
            reads.add(len(b))
            yield b

    rows = spark.read.parquet(str(tmp_path / "t")).mapInPandas(counting, "v double")
    got = {r["prob"]: r["threshold"] for r in R.exact_quantiles(rows, "v", [0.5, 0.9]).collect()}
    assert got == {0.5: pytest.approx(9999.5), 0.9: pytest.approx(17999.1)}
    assert reads.value == 2 * 20000


def plain_band(rows, replicates, level, seed=1234):
    import hashlib
    import math

    cdf, term, total = [], math.exp(-1.0), 0.0
    for n in range(40):
        total += term
        cdf.append(total)
        term /= n + 1
    means = {}
    for k, key, m in rows:
        for b in range(replicates):
            digest = hashlib.md5(f"{seed}:{key}:{b // 4}".encode()).hexdigest()
            u = int(digest[8 * (b % 4) : 8 * (b % 4) + 8], 16) / 2**32
            w = sum(u >= c for c in cdf)
            s = means.setdefault((k, b), [0.0, 0])
            s[0] += w * m
            s[1] += w
    tail = (1 - level) / 2
    for k in {r[0] for r in rows}:
        x = [s / w for (kk, _), (s, w) in means.items() if kk == k and w]
        yield k, np.quantile(x, tail), np.quantile(x, 1 - tail)


def test_bootstrap_band_by_hand(spark):
    rng = np.random.default_rng(6)
    rows = [(k, f"{k}-{i}", float(rng.normal(k, 1 + k))) for k in (1, 5, 9) for i in range(12)]
    df = spark.createDataFrame([*rows, (1, "no metric", None), (13, "alone", 2.0)], "k int, key string, m double").repartition(4)
    got = {r["k"]: (r["low"], r["high"]) for r in R.bootstrap_band(df, "k", "m", ["key"], 50, 0.9).collect()}
    assert got.pop(13) == (2.0, 2.0)
    want = {k: (a, b) for k, a, b in plain_band(rows, 50, 0.9)}
    assert got.keys() == want.keys()
    for k in want:
        assert got[k] == pytest.approx(want[k])
    assert R.bootstrap_band(df.limit(0), "k", "m", ["key"], 50).collect() == []


def test_bootstrap_weights_are_poisson():
    cdf = R.poisson_one_cdf()
    u = np.random.default_rng(1).random(200_000)
    w = sum((u >= c).astype(int) for c in cdf)
    assert w.mean() == pytest.approx(1, abs=0.01) and w.var() == pytest.approx(1, abs=0.02)
    assert cdf[0] == pytest.approx(np.exp(-1)) and cdf[-1] <= 1
