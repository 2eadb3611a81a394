"""Classification and PU metrics as one-pass aggregates.

AUL and the lift curve are rank statistics. The reference loops over all
positive x all pairs; here rows are first counted per (group, score) - a heavy tie
group collapses to one row before any shuffle - and a running count over the
distinct scores (``ranking.prefix_sums``) gives the rows below each score.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import bce_to
from ..session import materialize
from .ranking import prefix_sums

# Largest number of lift-curve points one expanded row emits.
EXPAND_CHUNK = 1 << 20


def _keys(keys) -> list[str]:
    if keys is None:
        return []
    return [keys] if isinstance(keys, str) else list(keys)


def _is1(c: str) -> Column:
    return F.col(c).cast("double") > 0.5


def confusion_counts(df: DataFrame, y: str, pred: str, keys: Sequence[str] = ()) -> DataFrame:
    """tp, fp, tn, fn, n per group (A1); labels and predictions above 0.5 count as 1."""
    keys = _keys(keys)
    yt, yp = _is1(y), _is1(pred)
    return df.groupBy(*keys).agg(
        F.sum((yt & yp).cast("long")).alias("tp"),
        F.sum((~yt & yp).cast("long")).alias("fp"),
        F.sum((~yt & ~yp).cast("long")).alias("tn"),
        F.sum((yt & ~yp).cast("long")).alias("fn"),
        F.count(F.lit(1)).alias("n"),
    )


def metrics_from_counts(counts: DataFrame) -> DataFrame:
    """accuracy (A2), balanced accuracy (A3), F1 (A4), predicted-positive rate."""
    tp, fp, tn, fn, n = (F.col(c).cast("double") for c in ("tp", "fp", "tn", "fn", "n"))
    rec1 = F.try_divide(tp, tp + fn)
    rec0 = F.try_divide(tn, tn + fp)
    bal = (
        F.when((tp + fn > 0) & (tn + fp > 0), (rec1 + rec0) / 2)
        .when(tp + fn > 0, rec1)
        .otherwise(rec0)
    )
    f1 = F.coalesce(F.try_divide(2 * tp, 2 * tp + fp + fn), F.lit(0.0))
    return (
        counts.withColumn("accuracy", F.try_divide(tp + tn, n))
        .withColumn("balanced_accuracy", bal)
        .withColumn("f1", f1)
        .withColumn("positive_rate", F.try_divide(tp + fp, n))
    )


def classification_metrics(df: DataFrame, y: str, pred: str, keys: Sequence[str] = ()) -> DataFrame:
    """All confusion-based metrics in one aggregate pass."""
    return metrics_from_counts(confusion_counts(df, y, pred, keys))


def pu_f1(df: DataFrame, y_pu: str, pred: str, keys: Sequence[str] = ()) -> DataFrame:
    """PU-F1 = recall^2 / Pr(pred = 1), recall over the known positives (A5).

    Above 1 is a valid value. Null when nothing is predicted positive or there is no
    known positive.
    """
    keys = _keys(keys)
    yt, yp = _is1(y_pu), _is1(pred)
    agg = df.groupBy(*keys).agg(
        F.sum((yt & yp).cast("long")).alias("_tp"),
        F.sum(yt.cast("long")).alias("_p"),
        F.sum(yp.cast("long")).alias("_pp"),
        F.count(F.lit(1)).alias("_n"),
    )
    recall = F.try_divide(F.col("_tp").cast("double"), F.col("_p").cast("double"))
    rate = F.try_divide(F.col("_pp").cast("double"), F.col("_n").cast("double"))
    return agg.select(
        *keys,
        recall.alias("recall"),
        rate.alias("positive_rate"),
        F.try_divide(recall * recall, F.when(rate > 0, rate)).alias("pu_f1"),
    )


def score_counts(df: DataFrame, y: str, score: str, keys: Sequence[str] = (), totals: bool = False) -> DataFrame:
    """Rows and positives per (group, distinct score) with the running count below (W4),
    and with ``totals`` the counts of the whole group."""
    keys = _keys(keys)
    per = df.groupBy(*keys, F.col(score).cast("double").alias("score")).agg(
        F.count(F.lit(1)).alias("cnt"), F.sum((F.col(y) == 1).cast("long")).alias("pos")
    )
    if totals:
        # sizes, buckets and rows are read from the counts: the scores are read once
        per = materialize(per, "score-counts")
    return prefix_sums(per, "score", ["cnt", "pos"], by=keys, totals_too=totals)


def aul(df: DataFrame, y: str, score: str, keys: Sequence[str] = ()) -> DataFrame:
    """Area under the lift curve, ``sum_{p in P} sum_{x} s(p, x) / (|P| n)``.

    Ties count 1/2 and self-pairs are included, as in the reference. Null when a group
    has no positive.
    """
    keys = _keys(keys)
    sc = score_counts(df, y, score, keys)
    agg = sc.groupBy(*keys).agg(
        F.sum(F.col("pos").cast("double") * (F.col("cnt_before") + 0.5 * F.col("cnt"))).alias("_acc"),
        F.sum("pos").alias("n_pos"),
        F.sum("cnt").alias("n"),
    )
    return agg.select(
        *keys,
        "n_pos",
        "n",
        F.try_divide(F.col("_acc"), F.col("n_pos").cast("double") * F.col("n").cast("double")).alias("aul"),
    )


def aul_binary(df: DataFrame, y: str, pred: str, keys: Sequence[str] = ()) -> DataFrame:
    """AUL of hard 0/1 predictions from the confusion counts in one aggregate.

    A positive predicted 1 beats every row predicted 0 and ties the rows predicted
    1; a positive predicted 0 ties the rows predicted 0:
    ``(tp (n0 + n1 / 2) + fn n0 / 2) / (|P| n)``, equal to ``aul`` on 0/1 scores.
    """
    c = confusion_counts(df, y, pred, keys)
    tp, fp, tn, fn = (F.col(x).cast("double") for x in ("tp", "fp", "tn", "fn"))
    n1, n0 = tp + fp, tn + fn
    return c.select(
        *_keys(keys),
        F.try_divide(tp * (n0 + 0.5 * n1) + fn * 0.5 * n0, (tp + fn) * F.col("n").cast("double")).alias("aul"),
    )


def lift_curve(df: DataFrame, y: str, score: str, keys: Sequence[str] = (), expand: bool = False) -> DataFrame:
    """PU lift curve (A7): the point (1, 1), then for each row in ascending score order the
    point ``(share with a higher score, share of positives with a higher score)``.

    Rows with equal scores give equal points, so the compact form has one row per
    distinct score with ``n_points``; ``expand=True`` returns the n + 1 points with
    their 1-based position ``pos`` (0 for the start point).
    """
    keys = _keys(keys)
    # one table carries the counts from below and, by the totals of its buckets, from above
    sc = score_counts(df, y, score, keys, totals=True)
    above = F.col("cnt_total") - F.col("cnt_before") - F.col("cnt")
    pos_above = F.col("pos_total") - F.col("pos_before") - F.col("pos")
    point = F.struct(
        F.col("score"),
        F.col("cnt").alias("n_points"),
        (F.col("cnt_before") + 1).alias("first_pos"),
        F.try_divide(above.cast("double"), F.col("cnt_total").cast("double")).alias("y_rate"),
        F.try_divide(pos_above.cast("double"), F.col("pos_total").cast("double")).alias("tpr"),
    )
    start = F.struct(
        F.lit(None).cast("double").alias("score"),
        F.lit(1).cast("long").alias("n_points"),
        F.lit(0).cast("long").alias("first_pos"),
        F.lit(1.0).alias("y_rate"),
        F.lit(1.0).alias("tpr"),
    )
    if keys:
        # the lowest score of a group brings the start point
        points = F.when(F.col("cnt_before") == 0, F.array(start, point)).otherwise(F.array(point))
        curve = sc.select(*keys, F.explode(points).alias("_p")).select(*keys, "_p.*")
    else:
        one = df.sparkSession.range(1).select(start.alias("_p")).select("_p.*")
        curve = one.unionByName(sc.select(point.alias("_p")).select("_p.*"))
    if not expand:
        return curve
    # a score shared by a third of the rows must not emit its points from one task:
    # cut each run into chunks of at most EXPAND_CHUNK points, spread the chunk rows
    # by a shuffle, then emit the points of each chunk
    c = EXPAND_CHUNK
    chunks = curve.withColumn(
        "_c", F.explode(F.sequence(F.lit(0), ((F.col("n_points") + c - 1) / c).cast("long") - 1))
    ).repartition(*keys, "score", "_c")
    first = F.col("first_pos") + F.col("_c") * c
    last = F.least(F.col("first_pos") + F.col("n_points"), first + c) - 1
    return chunks.select(*keys, F.explode(F.sequence(first, last)).alias("pos"), "y_rate", "tpr")


def prior(df: DataFrame, y: str, keys: Sequence[str] = ()) -> DataFrame:
    """Class prior = share of label 1."""
    return df.groupBy(*_keys(keys)).agg(F.avg(F.col(y).cast("double")).alias("prior"))


def nnpu_risk(
    df: DataFrame, y_pu: str, prob: str, positive_prior: float, keys: Sequence[str] = ()
) -> DataFrame:
    """Non-negative PU risk with clipped binary cross-entropy (A21, F11):
    ``pi * E_P[l(1,p)] + max(0, E_U[l(0,p)] - pi * E_P[l(0,p)])``."""
    keys = _keys(keys)
    pos = F.col(y_pu) == 1
    unl = F.col(y_pu) == 0
    agg = df.groupBy(*keys).agg(
        F.avg(F.when(pos, bce_to(1, prob))).alias("_pp"),
        F.avg(F.when(unl, bce_to(0, prob))).alias("_un"),
        F.avg(F.when(pos, bce_to(0, prob))).alias("_pn"),
    )
    pi = F.lit(float(positive_prior))
    return agg.select(
        *keys,
        (pi * F.col("_pp")).alias("positive_risk"),
        (F.col("_un") - pi * F.col("_pn")).alias("negative_risk"),
        (pi * F.col("_pp") + F.greatest(F.lit(0.0), F.col("_un") - pi * F.col("_pn"))).alias("nnpu_risk"),
    )
