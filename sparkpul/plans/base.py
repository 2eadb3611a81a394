"""Base classifiers (M11-M15) with one interface.

``clf.fit(df, label_col) -> model``; ``model.predict_proba(df) -> df + prob``
(probability of class 1, B7) and ``model.predict(df) -> df + prediction``. Features
are an ``array<double>`` column; MLlib sees a vector only inside fit / transform.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pyspark.ml  # noqa: F401  here, as threads that import it side by side can fail
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import md5_key
from ..operators.knn import knn_join
from ..operators.ranking import hash_rank
from ..operators.splits import DEFAULT_SEED
from ..session import ensure_checkpoint_dir, materialize, scratch_path
from . import forest, newton
from .blocks import pack


def _vec(col: str = "features") -> Column:
    from pyspark.ml.functions import array_to_vector

    return array_to_vector(F.col(col).cast("array<double>"))


def _p1(col: str = "probability") -> Column:
    from pyspark.ml.functions import vector_to_array

    return vector_to_array(F.col(col))[1]


def dot_plus(features: str, w: np.ndarray, b: float) -> Column:
    """``features . w + b`` with the weights as literals (a small model)."""
    lit = F.array(*[F.lit(float(x)) for x in w])
    v = F.col(features).cast("array<double>")
    return F.aggregate(F.zip_with(v, lit, lambda a, c: a * c), F.lit(float(b)), lambda s, x: s + x)


class Fitted:
    """Common predict on top of ``predict_proba``."""

    threshold = 0.5

    def predict_proba(self, df: DataFrame, features: str = "features", out: str = "prob") -> DataFrame:
        raise NotImplementedError

    def predict(self, df: DataFrame, features: str = "features", out: str = "prediction") -> DataFrame:
        p = self.predict_proba(df, features, "_p")
        return p.withColumn(out, (F.col("_p") > self.threshold).cast("int")).drop("_p")


class _MLlibFitted(Fitted):
    def __init__(self, model):
        self.model = model

    def predict_proba(self, df, features="features", out="prob"):
        cols = df.columns
        t = self.model.transform(df.withColumn("_vec", _vec(features)))
        return t.select(*cols, _p1("probability").alias(out))


class LinearFitted(Fitted):
    """A logistic model ``1 / (1 + exp(-(w x + b)))``; an infinite ``b`` is a constant."""

    def __init__(self, weights: np.ndarray, intercept: float, passes: int = 0):
        #: weights and intercept, as callers that combine linear models read them
        self.linear = (weights, intercept)
        #: passes over the data, one Spark job each
        self.passes = passes

    def predict_proba(self, df, features="features", out="prob"):
        w, b = self.linear
        if math.isinf(b):
            return df.withColumn(out, F.lit(1.0 if b > 0 else 0.0))
        return df.withColumn(out, F.lit(1.0) / (F.lit(1.0) + F.exp(-dot_plus(features, w, b))))


class LogisticClassifier:
    """Logistic regression (M11) by Newton's method on ``C * sum(loss) + |w|^2 / 2`` with a
    free intercept, one pass over the rows a step. ``fit_many`` fits one model per label
    column in the same passes."""

    name = "logistic"

    def __init__(self, C: float = 1.0, max_iter: int = 10_000):
        self.C, self.max_iter = C, max_iter

    def fit(self, df: DataFrame, label: str, features: str = "features", n_rows: int | None = None):
        return self._fit(df, F.array(F.col(label).cast("double")), 1, features)[0]

    def fit_many(self, df: DataFrame, labels: str, members: int, features: str = "features") -> list[LinearFitted]:
        """One model per entry of the array column ``labels``."""
        return self._fit(df, F.col(labels).cast("array<double>"), members, features)

    def _fit(self, df: DataFrame, labels: Column, members: int, features: str) -> list[LinearFitted]:
        blocks = pack(df, {"x": F.col(features), "y": labels})
        found = newton.fit(blocks, members, "logistic", self.C, max_passes=self.max_iter)
        return [LinearFitted(w[:-1], float(w[-1]), found.passes) for w in found.weights]


#: rows times trees that one MLlib fit grows; its trees are on the driver, about a node for
#: three of them
TREE_ROWS = 2_000_000
#: rows from which such forests are grown by the tasks (``forest``), not by MLlib
LARGE_ROWS = 20_000


class RandomForest:
    """Random forest (M14): 100 trees of MLlib's greatest depth, seeded (the reference
    leaves it unseeded and its trees grow without a limit).

    Rows keep the number of their node in each tree, so that trees are not sent to the tasks
    of every level. A forest of more than ``TREE_ROWS`` rows times trees is grown in several
    fits, each with a seed of its own, and written part by part: the driver holds one. With more
    than ``LARGE_ROWS`` rows MLlib's histograms of every level cost more than the rows: its rules
    are then followed by ``forest.grow``, where a task grows all below a node that it can hold.
    """

    name = "rf"

    def __init__(self, num_trees: int = 100, max_depth: int = 30, seed: int = DEFAULT_SEED):
        self.num_trees, self.max_depth, self.seed = num_trees, max_depth, seed

    def fit(self, df: DataFrame, label: str, features: str = "features", n_rows: int | None = None):
        rows = df.select(_vec(features).alias("_vec"), F.col(label).cast("double").alias("_y"))
        n_rows = n_rows or rows.count()
        at_once = max(1, TREE_ROWS // max(1, n_rows))
        if at_once >= self.num_trees:
            return _MLlibFitted(self._grow(rows, self.num_trees, self.seed))
        if n_rows > LARGE_ROWS:
            return _GrownForest(forest.grow(df, label, features, self.num_trees, self.max_depth, self.seed))
        rows = materialize(df.select(F.col(features), F.col(label).alias("_y")), "forest-rows").select(
            _vec(features).alias("_vec"), F.col("_y").cast("double").alias("_y")
        )
        paths = []
        for first in range(0, self.num_trees, at_once):
            paths.append(scratch_path(df.sparkSession, "forest"))
            self._grow(rows, min(at_once, self.num_trees - first), self.seed + first).write().save(paths[-1])
        return _ForestFitted(paths)

    def _grow(self, rows: DataFrame, trees: int, seed: int):
        from pyspark.ml.classification import RandomForestClassifier

        ensure_checkpoint_dir(rows.sparkSession)
        return RandomForestClassifier(
            featuresCol="_vec", labelCol="_y", numTrees=trees, maxDepth=self.max_depth, seed=seed, cacheNodeIds=True
        ).fit(rows)


class _ForestFitted(Fitted):
    """A forest in several files, read one after the other; their votes are added up."""

    def __init__(self, paths: list[str]):
        self.paths = paths

    def predict_proba(self, df, features="features", out="prob"):
        from pyspark.ml.classification import RandomForestClassificationModel
        from pyspark.ml.functions import vector_to_array

        cols = df.columns
        votes = df.withColumn("_votes", F.array(F.lit(0.0), F.lit(0.0)))
        for path in self.paths:
            part = RandomForestClassificationModel.load(path)
            told = part.transform(votes.withColumn("_vec", _vec(features)))
            both = F.zip_with("_votes", vector_to_array("rawPrediction"), lambda a, b: a + F.coalesce(b, F.lit(0.0)))
            votes = materialize(told.select(*cols, both.alias("_votes")), "forest-votes")
        return votes.select(*cols, (F.col("_votes")[1] / (F.col("_votes")[0] + F.col("_votes")[1])).alias(out))


class _GrownForest(Fitted):
    def __init__(self, grown: forest.Forest):
        self.grown = grown

    def predict_proba(self, df, features="features", out="prob"):
        return self.grown.predict(df, features, out)


class GaussianNB:
    """Gaussian naive Bayes (M13) from class moments.

    Per class and feature: mean and population variance, plus ``1e-9 x`` the largest
    feature variance (sklearn's ``var_smoothing``). The model is classes x features,
    so it is kept as literals; prediction is a Column expression.
    """

    name = "naivebayes"

    def __init__(self, var_smoothing: float = 1e-9):
        self.var_smoothing = var_smoothing

    def fit(self, df: DataFrame, label: str, features: str = "features", n_rows: int | None = None):
        from pyspark.ml.stat import Summarizer

        # mean and variance vectors per class in one pass, rows as they are
        stats = Summarizer.metrics("count", "mean", "variance").summary(F.col("_vec")).alias("s")
        per = df.select(F.col(label).cast("int").alias("_y"), _vec(features).alias("_vec")).groupBy("_y").agg(stats).select(
            "_y", "s.count", "s.mean", "s.variance"
        ).collect()  # one row per class
        cnt = {r["_y"]: int(r["count"]) for r in per}
        mean = {r["_y"]: r["mean"].toArray() for r in per}
        # the summarizer's variance has n - 1 below
        var = {r["_y"]: r["variance"].toArray() * (r["count"] - 1) / r["count"] for r in per}
        classes, total = sorted(cnt), sum(cnt.values())
        # variance of each feature over all rows, from the class moments:
        # n var = sum_c n_c (var_c + (m_c - m)^2)
        middle = sum(cnt[c] * mean[c] for c in classes) / total
        spread = sum(cnt[c] * (var[c] + (mean[c] - middle) ** 2) for c in classes) / total
        # constant features everywhere: any positive width gives the same posterior
        eps = self.var_smoothing * float(spread.max()) or self.var_smoothing
        var = {c: var[c] + eps for c in classes}
        return _NBFitted(classes, mean, var, {c: cnt[c] / total for c in classes})


class _NBFitted(Fitted):
    def __init__(self, classes, mean, var, prior):
        self.classes, self.mean, self.var, self.prior = classes, mean, var, prior

    def joint_log_likelihood(self, features: str, c: int) -> Column:
        mu = F.array(*[F.lit(float(x)) for x in self.mean[c]])
        vr = F.array(*[F.lit(float(x)) for x in self.var[c]])
        v = F.col(features).cast("array<double>")
        terms = F.zip_with(F.arrays_zip(v.alias("x"), mu.alias("m")), vr,
                           lambda xm, s: -0.5 * F.log(2 * math.pi * s) - (xm["x"] - xm["m"]) * (xm["x"] - xm["m"]) / (2 * s))
        return F.aggregate(terms, F.lit(math.log(self.prior[c])), lambda a, t: a + t)

    def predict_proba(self, df, features="features", out="prob"):
        if 1 not in self.classes:
            return df.withColumn(out, F.lit(0.0))
        if 0 not in self.classes:
            return df.withColumn(out, F.lit(1.0))
        d = self.joint_log_likelihood(features, 0) - self.joint_log_likelihood(features, 1)
        return df.withColumn(out, F.lit(1.0) / (F.lit(1.0) + F.exp(d)))


class KNeighbours:
    """k-nearest-neighbour classifier (M12): vote share of class 1 among the k nearest
    training rows, via the exact kNN join. ``fit_many`` fits one model per k, which are
    asked by one join."""

    def __init__(self, k: int = 5, id_col: str = "vec_id"):
        self.k, self.id_col = k, id_col
        self.name = f"kneighbours-{k}"

    def fit(self, df: DataFrame, label: str, features: str = "features", n_rows: int | None = None):
        return self.fit_many(df, label, [self.k], features)[0]

    def fit_many(self, df: DataFrame, label: str, ks: Sequence[int], features: str = "features") -> list[_KNNFitted]:
        train = df.select(self.id_col, F.col(features).alias("_f"), F.col(label).alias("_y"))
        near = _Neighbours(train, max(ks), self.id_col)
        return [_KNNFitted(near, k) for k in ks]


class _Neighbours:
    """The ``most`` nearest training rows; the k nearest are those of rank 1 to k."""

    def __init__(self, train: DataFrame, most: int, id_col: str):
        self.train, self.most, self.id_col = train, most, id_col
        self.last: tuple | None = None

    def of(self, df: DataFrame, features: str) -> DataFrame:
        """``_qid, nn_rank, _y``; found once as long as the same frame is asked."""
        if self.last is None or self.last[0] is not df or self.last[1] != features:
            q = df.select(F.col(self.id_col).alias("_qid"), F.col(features).alias("_f"))
            ref = self.train.withColumnRenamed(self.id_col, "_rid")
            self.last = df, features, knn_join(q, ref, self.most, "_qid", "_rid", "_f", "_f", carry=["_y"])
        return self.last[2]


class _KNNFitted(Fitted):
    def __init__(self, near: _Neighbours, k: int):
        self.near, self.k, self.id_col = near, k, near.id_col

    def predict_proba(self, df, features="features", out="prob"):
        nn = self.near.of(df, features).where(F.col("nn_rank") <= self.k)
        share = nn.groupBy("_qid").agg(F.avg(F.col("_y").cast("double")).alias(out))
        return df.join(share.withColumnRenamed("_qid", self.id_col), self.id_col, "left")


class CalibratedSVM:
    """Linear SVM calibrated by a sigmoid in stratified folds.

    The SVM minimises ``C * sum(max(0, 1 - s f)^2) + (|w|^2 + b^2) / 2``, as the published
    experiments' solver does, by Newton steps on the rows inside the margin. The models of
    all folds are fitted in the same passes: a row weighs 0 in the model of its own fold.
    Then a sigmoid ``1 / (1 + exp(-(a m + b)))`` per fold is fitted to the held-out margins
    with Platt's soft targets; the probability is the mean over the folds.
    """

    name = "svm"

    def __init__(self, folds: int = 5, C: float = 1.0, max_iter: int = 100, seed: int = DEFAULT_SEED, id_col: str = "vec_id"):
        self.folds, self.C, self.max_iter, self.seed, self.id_col = folds, C, max_iter, seed, id_col

    def _folded(self, data: DataFrame) -> DataFrame:
        """``data`` with ``_fold``: equal shares of each label, in the order of md5 keys."""
        keyed = data.withColumn("_hk", md5_key(self.seed, self.id_col))
        ranked = hash_rank(keyed, "_hk", self.id_col, by=["_y"], rank_col="_r", n_rows=data.count())
        sizes = ranked.groupBy("_y").agg(F.count(F.lit(1)).alias("_n"))
        fold = F.floor((F.col("_r") - 1) * self.folds / F.col("_n")).cast("int")
        return materialize(ranked.join(sizes, "_y").select("_x", "_y", fold.alias("_fold")), "folds")

    def fit(self, df: DataFrame, label: str, features: str = "features", n_rows: int | None = None):
        folded = self._folded(df.select(self.id_col, F.col(features).alias("_x"), F.col(label).cast("double").alias("_y")))
        k = range(self.folds)
        outside = F.array(*[(F.col("_fold") != j).cast("double") for j in k])
        same = F.array_repeat("_y", self.folds)
        blocks = pack(folded, {"x": F.col("_x"), "y": same, "w": outside})
        svm = newton.fit(blocks, self.folds, "squared_hinge", self.C, penalize_intercept=True, weighted=True,
                         max_passes=self.max_iter)
        margin = F.lit(None).cast("double")
        for j in k:
            margin = F.when(F.col("_fold") == j, dot_plus("_x", svm.weights[j][:-1], float(svm.weights[j][-1]))).otherwise(margin)
        # Platt's targets (n1 + 1) / (n1 + 2) and 1 / (n0 + 2) of the held-out rows of a fold
        sizes = {(r["_fold"], r["_y"]): r["n"] for r in folded.groupBy("_fold", "_y").agg(F.count("*").alias("n")).collect()}
        target = F.lit(None).cast("double")
        for j in k:
            n1, n0 = sizes.get((j, 1.0), 0), sizes.get((j, 0.0), 0)
            soft = F.when(F.col("_y") == 1, F.lit((n1 + 1) / (n1 + 2))).otherwise(F.lit(1 / (n0 + 2)))
            target = F.when(F.col("_fold") == j, soft).otherwise(target)
        inside = F.array(*[(F.col("_fold") == j).cast("double") for j in k])
        held = pack(folded, {"x": F.array(margin), "y": F.array_repeat(target, self.folds), "w": inside})
        platt = newton.fit(held, self.folds, "logistic", penalty=0.0, weighted=True, max_passes=self.max_iter)
        return _SVMFitted(svm.weights, platt.weights, svm.passes + platt.passes)


class _SVMFitted(Fitted):
    def __init__(self, svms: np.ndarray, sigmoids: np.ndarray, passes: int):
        self.svms, self.sigmoids, self.passes = svms, sigmoids, passes

    def predict_proba(self, df, features="features", out="prob"):
        probs = []
        for w, (a, b) in zip(self.svms, self.sigmoids, strict=True):
            margin = dot_plus(features, w[:-1], float(w[-1]))
            probs.append(F.lit(1.0) / (F.lit(1.0) + F.exp(-(F.lit(float(a)) * margin + F.lit(float(b))))))
        return df.withColumn(out, sum(probs[1:], probs[0]) / len(probs))


def make_classifier(name: str, **kw):
    """Factory by the names used in the experiments."""
    if name == "logistic":
        return LogisticClassifier(**kw)
    if name == "naivebayes":
        return GaussianNB(**kw)
    if name == "rf":
        return RandomForest(**kw)
    if name == "svm":
        return CalibratedSVM(**kw)
    if name.startswith("kneighbours"):
        k = int(name.split("-")[1]) if "-" in name else kw.pop("k", 5)
        return KNeighbours(k=k, **kw)
    raise ValueError(f"unknown classifier {name}")
