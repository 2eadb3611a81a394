"""Newton fits of many members against plain numpy, and the passes they take."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkpul.plans import blocks as B
from sparkpul.plans import newton
from sparkpul.plans.base import CalibratedSVM, LogisticClassifier
from sparkpul.plans.models import ProbTagging


def fixture(spark, n=400, d=5, members=6, seed=3):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, d))
    z = x @ rng.normal(size=(d, members)) + rng.normal(size=(n, members))
    tags = (z > rng.normal(size=members)).astype(float)
    rows = [(i, x[i].tolist(), tags[i].tolist(), int(tags[i, 0])) for i in range(n)]
    return x, tags, spark.createDataFrame(rows, "vec_id long, features array<double>, tags array<double>, y int").repartition(4)


def plain_logistic(x, y, C=1.0, penalty=1.0, w=None):
    a = np.hstack([x, np.ones((len(x), 1))])
    w = np.ones(len(x)) if w is None else w
    pen = np.array([penalty] * x.shape[1] + [0.0])
    b = np.zeros(a.shape[1])
    for _ in range(60):
        p = 1 / (1 + np.exp(-a @ b))
        g = C * a.T @ (w * (p - y)) + pen * b
        h = C * a.T @ (a * (w * p * (1 - p))[:, None]) + np.diag(pen)
        b -= np.linalg.solve(h, g)
    return b


def plain_svm(x, y, C=1.0):
    """Gradient descent with a fixed curvature bound, run to the optimum."""
    a, s = np.hstack([x, np.ones((len(x), 1))]), 2 * y - 1
    bound = np.linalg.inv(np.eye(a.shape[1]) + 2 * C * a.T @ a)
    b = np.zeros(a.shape[1])
    for _ in range(4000):
        short = np.maximum(0, 1 - s * (a @ b))
        b -= bound @ (b - 2 * C * a.T @ (s * short))
    return b


def test_all_members_in_few_passes(spark):
    x, tags, df = fixture(spark, members=50)
    group = "newton-jobs"
    spark.sparkContext.setJobGroup(group, "count jobs")
    models = LogisticClassifier().fit_many(df, "tags", 50)
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    for j, m in enumerate(models):
        assert np.allclose([*m.linear[0], m.linear[1]], plain_logistic(x, tags[:, j]), atol=1e-8)
    # packing, its width and partitions, and one job a Newton step
    assert models[0].passes < 10 and jobs <= models[0].passes + 5


def test_one_member_and_scaling(spark):
    x, tags, df = fixture(spark)
    m = LogisticClassifier(C=0.05).fit(df, "y")
    assert np.allclose([*m.linear[0], m.linear[1]], plain_logistic(x, tags[:, 0], C=0.05), atol=1e-8)
    got = m.predict_proba(df, out="p").toPandas().sort_values("vec_id")["p"].to_numpy()
    assert np.allclose(got, 1 / (1 + np.exp(-(x @ m.linear[0] + m.linear[1]))), atol=1e-12)


def test_members_take_turns(spark, monkeypatch):
    """More Gram matrices than a task may hold, and sums on the executors."""
    _, _, df = fixture(spark)
    want = [m.linear for m in LogisticClassifier().fit_many(df, "tags", 6)]
    monkeypatch.setattr(newton, "GRAM_BYTES", 2 * 8 * 36)
    monkeypatch.setattr(B, "DIRECT_ROWS", 1)
    monkeypatch.setattr(B, "BLOCK_BYTES", 800)
    got = [m.linear for m in LogisticClassifier().fit_many(df, "tags", 6)]
    for a, b in zip(want, got):
        assert np.allclose(a[0], b[0], atol=1e-9) and a[1] == pytest.approx(b[1], abs=1e-9)


def test_separable_and_one_class(spark):
    rows = [(i, [float(i), 1.0], [1.0, 0.0, float(i > 4)]) for i in range(10)]
    df = spark.createDataFrame(rows, "vec_id long, features array<double>, tags array<double>")
    ones, zeros, split = LogisticClassifier().fit_many(df, "tags", 3)
    assert ones.linear[1] == np.inf and zeros.linear[1] == -np.inf and np.isfinite(split.linear[1])
    assert {r["p"] for r in ones.predict_proba(df, out="p").collect()} == {1.0}
    assert {r["p"] for r in zeros.predict_proba(df, out="p").collect()} == {0.0}
    got = split.predict(df, out="p").orderBy("vec_id").collect()
    assert [r["p"] for r in got] == [0] * 5 + [1] * 5
    with pytest.raises(ValueError):
        LogisticClassifier().fit_many(df.limit(0), "tags", 3)


def test_rows_without_a_value_are_left_out(spark):
    x, tags, df = fixture(spark)
    more = df.unionByName(spark.createDataFrame([(900, None, None, 1), (901, [0.0] * 5, None, None)], df.schema))
    a, b = LogisticClassifier().fit_many(more, "tags", 6), LogisticClassifier().fit_many(df, "tags", 6)
    assert all(np.allclose(p.linear[0], q.linear[0], atol=1e-9) for p, q in zip(a, b))


def test_squared_hinge(spark):
    x, tags, df = fixture(spark)
    packed = B.pack(df, {"x": F.col("features"), "y": F.col("tags")})
    found = newton.fit(packed, 6, "squared_hinge", C=0.7, penalize_intercept=True)
    for j in range(6):
        assert np.allclose(found.weights[j], plain_svm(x, tags[:, j], C=0.7), atol=1e-7)
    assert found.passes < 20


def test_calibrated_svm_by_hand(spark):
    """Folds, margins and sigmoids recomputed with numpy."""
    x, tags, df = fixture(spark)
    y = tags[:, 0]
    svm = CalibratedSVM(folds=4)
    folded = svm._folded(df.select("vec_id", F.col("features").alias("_x"), F.col("y").cast("double").alias("_y"))).toPandas()
    place = {tuple(v): i for i, v in enumerate(x.tolist())}
    fold = np.empty(len(x), int)
    for v, f in zip(folded["_x"], folded["_fold"]):
        fold[place[tuple(v)]] = f
    for c in (0, 1):
        counts = np.bincount(fold[y == c], minlength=4)
        assert counts.max() - counts.min() <= 1
    p = np.zeros(len(x))
    for f in range(4):
        w = plain_svm(x[fold != f], y[fold != f])
        held = x[fold == f] @ w[:-1] + w[-1]
        n1, n0 = (y[fold == f] == 1).sum(), (y[fold == f] == 0).sum()
        soft = np.where(y[fold == f] == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
        a, b = plain_logistic(held[:, None], soft, penalty=0.0)
        p += 1 / (1 + np.exp(-(a * (x @ w[:-1] + w[-1]) + b))) / 4
    got = svm.fit(df, "y").predict_proba(df, out="p").toPandas().sort_values("vec_id")["p"].to_numpy()
    assert np.allclose(got, p, atol=1e-6)


def test_prob_tagging_members_share_passes(spark):
    """The members equal those fitted one by one."""

    class Single(LogisticClassifier):
        fit_many = property()  # no joint fit: one by one

    rng = np.random.default_rng(1)
    x = rng.normal(size=(120, 3))
    rows = [(i, x[i].tolist(), int(x[i, 0] > 0.6)) for i in range(120)]
    df = spark.createDataFrame(rows, "vec_id long, features array<double>, y_pu int")
    joint = ProbTagging(7, LogisticClassifier, 5).fit(df)
    alone = ProbTagging(7, Single, 5).fit(df)
    for a, b in zip(joint.models, alone.models):
        assert np.allclose(a.linear[0], b.linear[0], atol=1e-8)
