"""PU algorithms and base classifiers: edge cases and closed forms."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from sparkpul.operators.detectors import KMeansDetector, KNNDetector, RandomDetector, rank_clusters
from sparkpul.plans.base import GaussianNB, make_classifier
from sparkpul.plans.models import NonNegativePU, NonStop, ProbTagging, StopOnMetricDrop, TwoStep


def _blobs(spark, n_pos=40, n_unl=60, seed=0):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n_pos):
        rows.append((i, (rng.normal(2.0, 0.5, 3)).tolist(), 1))
    for i in range(n_unl):
        c = 2.0 if i % 3 == 0 else -2.0
        rows.append((n_pos + i, (rng.normal(c, 0.5, 3)).tolist(), 0))
    return spark.createDataFrame(rows, "vec_id long, features array<double>, y_pu int")


def test_two_step_tiny_move_stops(spark):
    df = _blobs(spark, 20, 50)
    algo = TwoStep(RandomDetector(0.5), None, make_classifier("logistic"), frac_to_move=0.01, max_iterations=5).fit(df)
    assert algo.iterations == 1
    assert algo.roles.where("role = 'U'").count() == 25


def test_two_step_moves_both_tails(spark):
    df = _blobs(spark)
    algo = TwoStep(KNNDetector(0.2, 3), NonStop("accuracy"), make_classifier("logistic"), frac_to_move=0.1,
                   max_iterations=2).fit(df, df)
    roles = {r["role"]: r["count"] for r in algo.roles.groupBy("role").count().collect()}
    # 60 U: 12 to N by the detector; each of the two rounds moves
    # floor(0.1 * 48) = 4 and floor(0.1 * 40) = 4 rows each way
    assert roles == {"P": 48, "N": 20, "U": 32}
    assert len(algo.validation_results) == 2


def test_two_step_rejects_large_fraction(spark):
    with pytest.raises(ValueError):
        TwoStep(RandomDetector(0.1), None, make_classifier("logistic"), frac_to_move=0.6)


def test_stop_on_drop_keeps_equal():
    s = StopOnMetricDrop("accuracy")
    assert s.last == float("-inf")


def test_kmeans_rank_clusters_lower_half():
    shares = {0: 0.9, 1: 0.0, 2: 0.1, 3: 0.5, 4: 0.0}
    cents = np.array([[0, 0], [10, 0], [5, 0], [1, 0], [20, 0]], dtype=float)
    ranked, dist = rank_clusters(shares, cents)
    # i < 5/2: the three smallest shares (1, 4, 2) are negative; farthest from {3, 0} first
    assert ranked == [4, 1, 2]


def test_kmeans_detector_takes_unlabeled_only(spark):
    df = _blobs(spark)
    neg = KMeansDetector(0.3, 4, centroids=[[2, 2, 2], [-2, -2, -2], [0, 0, 0], [5, 5, 5]]).negatives(df, "vec_id")
    ids = [r["vec_id"] for r in neg.collect()]
    assert len(ids) == math.floor(60 * 0.3)
    assert all(i >= 40 for i in ids)


def test_gaussian_nb_matches_numpy(spark):
    df = _blobs(spark)
    pdf = df.toPandas()
    x = np.stack(pdf.features.to_numpy())
    y = pdf.y_pu.to_numpy()
    model = GaussianNB().fit(df, "y_pu")
    got = model.predict_proba(df, out="p").toPandas().sort_values("vec_id")["p"].to_numpy()
    eps = 1e-9 * x.var(axis=0).max()
    jll = []
    for c in (0, 1):
        xc = x[y == c]
        mu, var = xc.mean(0), xc.var(0) + eps
        jll.append(np.log(len(xc) / len(x)) - 0.5 * np.log(2 * np.pi * var).sum() - ((x - mu) ** 2 / (2 * var)).sum(1))
    exp = 1 / (1 + np.exp(jll[0] - jll[1]))
    assert np.allclose(got, exp, atol=1e-9)


def test_nnpu_risk_goes_down(spark):
    df = _blobs(spark)
    algo = NonNegativePU([1], 0.5, epochs=15, learning_rate=0.05).fit(df)
    risks = [h["risk"] for h in algo.history]
    assert risks[-1] < risks[0]
    p = algo.predict_proba(df, out="p").agg(F.min("p"), F.max("p")).first()
    assert 0.0 <= p[0] <= p[1] <= 1.0


def test_prob_tagging_predicts(spark):
    df = _blobs(spark)
    algo = ProbTagging(3, lambda: make_classifier("logistic"), 2).fit(df)
    out = algo.predict(df).toPandas()
    assert set(out.prediction.unique()) <= {0, 1}


def test_nearest_centroid(spark):
    """The nearest by exact distance, the lowest index among equals."""
    from sparkpul.operators import detectors as D

    df = _blobs(spark)
    cents = np.array([[2, 2, 2], [-2, -2, -2], [0, 0, 0], [2, 2, 2]], dtype=float)
    got = {r["vec_id"]: r["cluster"] for r in D.nearest_centroid(df, "features", cents).collect()}
    for r in df.collect():
        d = np.linalg.norm(cents - np.array(r["features"]), axis=1)
        assert got[r["vec_id"]] == int(np.argmin(np.round(d, 9)))


def test_nnpu_two_level_gradient_sum(spark, monkeypatch):
    from sparkpul.plans import models as MOD

    df = _blobs(spark).repartition(6)
    a = NonNegativePU([1], 0.5, epochs=3, learning_rate=0.05).fit(df)
    monkeypatch.setattr(MOD, "DIRECT_GRADIENT_ROWS", 2)
    b = NonNegativePU([1], 0.5, epochs=3, learning_rate=0.05).fit(df)
    assert np.allclose(a.weights[0][0], b.weights[0][0], atol=1e-12)


def test_empty_positive_set_is_a_clear_error(spark):
    df = _blobs(spark).withColumn("y_pu", F.lit(0))
    with pytest.raises(ValueError):
        KNNDetector(0.1, 3).negatives(df, "vec_id")


def test_empty_unlabeled_set(spark):
    df = _blobs(spark).withColumn("y_pu", F.lit(1))
    assert KNNDetector(0.1, 3).negatives(df, "vec_id").count() == 0
    assert RandomDetector(0.5).negatives(df, "vec_id").count() == 0
    roles = KMeansDetector(0.3, 2, centroids=[[2, 2, 2], [-2, -2, -2]]).detect(df, "vec_id")
    assert {r["role"] for r in roles.collect()} == {"P"}


def test_aul_without_positives_is_null(spark):
    df = spark.createDataFrame([(0, 0.1), (0, 0.4)], "y int, s double")
    from sparkpul.operators import metrics as M

    assert M.aul(df, "y", "s").first()["aul"] is None


def test_two_step_negatives_only_and_label_ranking(spark):
    df = _blobs(spark)
    algo = TwoStep(RandomDetector(0.2), None, make_classifier("logistic"), frac_to_move=0.1, max_iterations=1,
                   move_positive=False).fit(df)
    roles = {r["role"]: r["count"] for r in algo.roles.groupBy("role").count().collect()}
    # 12 detected negatives, then floor(0.1 * 48) = 4 more negatives and no new positive
    assert roles == {"P": 40, "N": 16, "U": 44}
    by_label = TwoStep(RandomDetector(0.2), None, make_classifier("logistic"), frac_to_move=0.1, max_iterations=1,
                       rank_by="label").fit(df)
    roles = {r["role"]: r["count"] for r in by_label.roles.groupBy("role").count().collect()}
    assert roles == {"P": 44, "N": 16, "U": 40}


class _FixedModel:
    """Stub classifier whose predictions are a given column."""

    def __init__(self, col):
        self.col = col

    def predict(self, df, features="features", out="prediction"):
        return df.withColumn(out, F.col(self.col))


def test_stop_on_metric_drop_sequence(spark):
    val = spark.createDataFrame([(1, 1, 1, 1, 0), (2, 0, 0, 0, 1), (3, 1, 1, 1, 1), (4, 0, 1, 1, 0)],
                                "id long, y_pu int, good int, same int, bad int")
    stop = StopOnMetricDrop("accuracy")
    assert stop.check(_FixedModel("good"), val) == (False, 0.75)
    assert stop.check(_FixedModel("same"), val) == (False, 0.75)  # equal: continue
    should_stop, value = stop.check(_FixedModel("bad"), val)
    assert should_stop and value == 0.5
    assert NonStop("aul").check(_FixedModel("bad"), val)[0] is False


class _FixedProbModel(_FixedModel):
    def predict_proba(self, df, features="features", out="prob"):
        return df.withColumn(out, F.col(self.col).cast("double"))


def test_prob_tagging_vote_share_against_prior(spark):
    df = spark.createDataFrame([(1, 1, 1, 0), (2, 1, 0, 0), (3, 0, 0, 0)], "vec_id long, a int, b int, c int")
    algo = ProbTagging(3, lambda: None, 3)
    algo.models = [_FixedProbModel("a"), _FixedProbModel("b"), _FixedProbModel("c")]
    algo.positive_prior = 0.3
    got = {r["vec_id"]: (r["prediction"], r["prob"]) for r in algo.predict(algo.predict_proba(df)).collect()}
    # vote shares 2/3, 1/3, 0 against the prior 0.3
    assert {k: v[0] for k, v in got.items()} == {1: 1, 2: 1, 3: 0}
    assert got[2][1] == pytest.approx(1 / 3)


def test_kmeans_detector_fit_is_reproducible(spark):
    df = _blobs(spark)
    a = sorted(r["vec_id"] for r in KMeansDetector(0.3, 3, seed=7).negatives(df, "vec_id").collect())
    b = sorted(r["vec_id"] for r in KMeansDetector(0.3, 3, seed=7).negatives(df, "vec_id").collect())
    assert a == b and len(a) == math.floor(60 * 0.3)
    assert all(i >= 40 for i in a)


def test_two_step_moves_no_features(spark):
    """Every join of a round reads the vectors from their buckets: no exchange above them."""
    import numpy as np

    from sparkpul.plans.models import NonStop, TwoStep

    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=3).tolist(), int(i % 5 == 0)) for i in range(200)]
    train = spark.createDataFrame(rows, "vec_id long, features array<double>, y_pu int")
    plans = []

    class Watched(TwoStep):
        def _joined(self, base, ids, how="inner"):
            out = super()._joined(base, ids, how)
            plans.append(out._jdf.queryExecution().executedPlan().toString())
            return out

    fitted = Watched(RandomDetector(0.2), NonStop("accuracy"), make_classifier("naivebayes"), 0.05, 3).fit(train, train)
    assert len(plans) == 6 and fitted.iterations == 3
    for plan in plans:
        lines = plan.splitlines()
        scans = [i for i, line in enumerate(lines) if "features" in line and "FileScan" in line]
        assert len(scans) == 1 and "Bucketed: true" in lines[scans[0]]
        # the lines above the scan on its branch: a join, then nothing that exchanges rows
        depth = lambda line: len(line) - len(line.lstrip(" :+-*(0123456789)"))
        above, at = [], depth(lines[scans[0]])
        for line in reversed(lines[: scans[0]]):
            if depth(line) < at:
                above.append(line)
                at = depth(line)
        assert not any("Exchange" in line for line in above), plan
        assert any("Exchange" in line for line in lines) and any("SortMergeJoin" in line for line in above)
