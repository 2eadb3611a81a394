"""Reliable-negative detectors (M1-M3, X2) on a PU table.

Input: a DataFrame with an id, a feature vector and ``y_pu`` (1 known positive,
0 unlabeled). Output: the same rows plus ``role`` in {P, N, U}. A custom detector is
any callable ``detect(df) -> df`` that adds ``role`` (X2).
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import md5_key
from ..session import checkpoint, ship_package
from .knn import _as_matrix, _topk_in_steps, mean_knn_distance
from .ranking import hash_rank, top_n

DEFAULT_SEED = 1234


def _roles(df: DataFrame, y_col: str, negatives: DataFrame, id_col: str) -> DataFrame:
    neg = negatives.select(id_col).withColumn("_neg", F.lit(True))
    return (
        df.join(neg, id_col, "left")
        .withColumn(
            "role",
            F.when(F.col(y_col) == 1, "P").when(F.col("_neg"), "N").otherwise("U"),
        )
        .drop("_neg")
    )


class RandomDetector:
    """A random ``floor(frac * |U|)`` of the unlabeled rows are negative (M1)."""

    def __init__(self, frac: float, seed: int = DEFAULT_SEED):
        self.frac, self.seed = frac, seed

    def negatives(self, df: DataFrame, id_col: str, y_col: str = "y_pu") -> DataFrame:
        unl = df.where(F.col(y_col) == 0)
        n_unl = unl.count()
        amount = math.floor(n_unl * self.frac)
        keyed = unl.withColumn("_hk", md5_key(self.seed, id_col))
        ranked = hash_rank(keyed, "_hk", id_col, rank_col="_r", n_rows=n_unl)
        return ranked.where(F.col("_r") <= amount).drop("_hk", "_r")

    def detect(self, df: DataFrame, id_col: str, y_col: str = "y_pu", vec_col: str = "features") -> DataFrame:
        return _roles(df, y_col, self.negatives(df, id_col, y_col), id_col)

    def label(self) -> str:
        return "random"


class KNNDetector:
    """Unlabeled rows farthest from their ``k`` nearest known positives are negative (M2).

    Mean distance to the k nearest positives ranks the unlabeled rows; the first
    ``floor(frac * |U|)`` by ``round(mean, 9)`` descending, then id, are taken.
    """

    def __init__(self, frac: float, k: int):
        self.frac, self.k = frac, k

    def scores(self, df: DataFrame, id_col: str, y_col: str = "y_pu", vec_col: str = "features") -> DataFrame:
        pos = df.where(F.col(y_col) == 1)
        unl = df.where(F.col(y_col) == 0)
        return mean_knn_distance(unl, pos, self.k, id_col, vec_col)

    def negatives(self, df: DataFrame, id_col: str, y_col: str = "y_pu", vec_col: str = "features") -> DataFrame:
        # one row per unlabeled row, read several times by the cut: materialized once
        sc = checkpoint(self.scores(df, id_col, y_col, vec_col).withColumn("_key", F.round("mean_dist", 9)))
        n_unl = sc.count()
        amount = math.floor(n_unl * self.frac)
        return top_n(sc, "_key", id_col, amount, descending=True, n_rows=n_unl).where("selected").drop("_key", "selected")

    def detect(self, df: DataFrame, id_col: str, y_col: str = "y_pu", vec_col: str = "features") -> DataFrame:
        return _roles(df, y_col, self.negatives(df, id_col, y_col, vec_col), id_col)

    def label(self) -> str:
        return f"knn-{self.k}"


def nearest_centroid(df: DataFrame, vec_col: str, centroids: np.ndarray, out: str = "cluster") -> DataFrame:
    """Index of the nearest centroid by the distance of differences rounded to 9 digits
    (ties: lowest index), as in the kNN join.

    The model (centroids x dimensions, a parameter of the method) is broadcast once; the
    tasks work on Arrow batches. One rule for every model size.
    """
    ship_package(df.sparkSession)
    bc = df.sparkSession.sparkContext.broadcast(np.asarray(centroids, dtype=np.float64))
    schema = T.StructType([*df.schema.fields, T.StructField(out, T.IntegerType())])

    def run(batches):
        model = bc.value
        ids = np.arange(len(model))
        for pdf in batches:
            if len(pdf):
                found = [c for _, c, _ in _topk_in_steps(_as_matrix(pdf[vec_col]), model, ids, 1)]
                yield pdf.assign(**{out: np.concatenate(found).astype(np.int32)})

    return df.mapInPandas(run, schema)


def rank_clusters(shares: dict[int, float], centroids: np.ndarray) -> tuple[list[int], dict[int, float]]:
    """Negative clusters ranked farthest first.

    Clusters sorted by positive share ascending (ties: cluster id); position
    ``i < n/2`` is negative. Each negative centroid is scored by its mean distance
    to the positive centroids.
    """
    ids = sorted(shares, key=lambda c: (shares[c], c))
    n = len(ids)
    neg = [c for i, c in enumerate(ids) if i < n / 2]
    pos = [c for i, c in enumerate(ids) if not i < n / 2]
    dist = {}
    for c in neg:
        if pos:
            dist[c] = float(np.mean([np.linalg.norm(centroids[c] - centroids[p]) for p in pos]))
        else:
            dist[c] = 0.0
    ranked = sorted(neg, key=lambda c: (-round(dist[c], 9), c))
    return ranked, dist


class KMeansDetector:
    """k-means reliable negatives (M3).

    Cluster P and U together, call the half of the clusters with the smallest positive
    share negative, rank those by mean distance to the positive centroids, and fill
    the quota ``floor(frac * |U|)`` with unlabeled rows of the farthest cluster first,
    random order (md5) inside a cluster. Deviations B1-B3 are fixed: only unlabeled
    rows are taken, ids are real cluster ids, and only taken rows leave U.

    ``centroids`` can be given (one row per cluster); otherwise MLlib ``KMeans`` fits
    them with the given seed.
    """

    def __init__(self, frac: float, n_clusters: int, seed: int = DEFAULT_SEED, centroids=None, max_iter: int = 300):
        self.frac, self.n_clusters, self.seed = frac, n_clusters, seed
        self.centroids = None if centroids is None else np.asarray(centroids, dtype=np.float64)
        self.max_iter = max_iter

    def fit_centroids(self, df: DataFrame, vec_col: str) -> np.ndarray:
        from pyspark.ml.clustering import KMeans
        from pyspark.ml.functions import array_to_vector

        vec = df.select(array_to_vector(F.col(vec_col).cast("array<double>")).alias("_v"))
        model = KMeans(k=self.n_clusters, seed=self.seed, featuresCol="_v", maxIter=self.max_iter).fit(vec)
        return np.array([np.asarray(c) for c in model.clusterCenters()])

    def negatives(self, df: DataFrame, id_col: str, y_col: str = "y_pu", vec_col: str = "features") -> DataFrame:
        cents = self.centroids if self.centroids is not None else self.fit_centroids(df, vec_col)
        # (id, label, cluster) is read four times below: materialized once
        clustered = checkpoint(nearest_centroid(df, vec_col, cents).select(id_col, y_col, "cluster"))
        shares = {
            r["cluster"]: r["share"]
            for r in clustered.groupBy("cluster").agg(F.avg(F.col(y_col).cast("double")).alias("share")).collect()
        }
        ranked, _ = rank_clusters(shares, cents)
        unl = clustered.where(F.col(y_col) == 0)
        n_unl = unl.count()
        quota = math.floor(n_unl * self.frac)
        if not ranked or quota == 0:
            return unl.limit(0).drop("cluster")
        order = {c: i for i, c in enumerate(ranked)}
        cand = unl.where(F.col("cluster").isin(ranked)).withColumn(
            "_crank", F.element_at(F.create_map(*[x for c in ranked for x in (F.lit(c), F.lit(order[c]))]), F.col("cluster"))
        )
        sizes = {r["_crank"]: r["n"] for r in cand.groupBy("_crank").agg(F.count(F.lit(1)).alias("n")).collect()}
        offset, acc = {}, 0
        for i in range(len(ranked)):
            offset[i] = acc
            acc += sizes.get(i, 0)
        keyed = cand.withColumn("_hk", md5_key(self.seed, id_col)).withColumn(
            "_off", F.element_at(F.create_map(*[x for i in offset for x in (F.lit(i), F.lit(offset[i]))]), F.col("_crank"))
        )
        ranked_rows = hash_rank(keyed, "_hk", id_col, by=["_crank"], rank_col="_r", n_rows=max(sizes.values(), default=1))
        return ranked_rows.where(F.col("_off") + F.col("_r") <= quota).drop("_hk", "_r", "_off", "_crank", "cluster")

    def detect(self, df: DataFrame, id_col: str, y_col: str = "y_pu", vec_col: str = "features") -> DataFrame:
        return _roles(df, y_col, self.negatives(df, id_col, y_col, vec_col), id_col)

    def label(self) -> str:
        return "k-means"
