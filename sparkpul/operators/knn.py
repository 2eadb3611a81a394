"""Exact k-nearest-neighbour join, Euclidean.

Three plans give the same rows:

* ``broadcast``: a reference whose counted bytes are at most ``BROADCAST_BYTES`` goes to
  every executor once; each task answers its query rows without a shuffle.
* ``blocks``: both sides are cut into tiles of bounded size by a hash, and every pair of
  a query tile and a reference tile is one group (``cogroup().applyInPandas``) that finds
  the k nearest of its reference rows for each of its query rows. The k best of all tiles
  are merged by ``row_number() <= k``, which Spark cuts down before the shuffle.
  With Q and R rows and tiles of ``t`` rows the shuffle moves ``Q * R / t`` rows of either
  side and ``Q * k * R / t`` candidates of three numbers. The size asked for is the least
  size: a side with more than ``MOST_TILES`` tiles gets larger ones, so that the shuffle
  grows with the rows, until a tile has ``TILE_VALUES`` numbers, which bounds a task's memory.
* ``quantised``: tiles of two bytes a dimension with distance bounds, exact distances for the
  survivors alone (``knn_quantised``).

Order and ties. A neighbour's distance is always computed by difference; neighbours are
ordered by that distance rounded to 9 digits, then by id, in every plan (N5). The matrix
form ``|q|^2 + |p|^2 - 2 q.p`` only preselects (``near``): every row within the form's
rounding error of the k-th place, or tied with it after rounding, is kept for the exact step.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import checkpoint, ship_package
from .knn_quantised import TIE, knn_quantised, tile_rows
from .near import near_pairs

# References of up to this many bytes (vectors, ids and carried columns) are broadcast.
BROADCAST_BYTES = 32 << 20
# Distance-matrix cells computed at once inside a task.
TASK_MATRIX_CELLS = 4_000_000
# Rows of a reference and of a query tile: raised so that a side has a bounded number of tiles
# (``tile_rows``), then lowered so that a tile has at most TILE_VALUES doubles.
BLOCK_ROWS = 16_384
QUERY_ROWS_PER_GROUP = 16_384
TILE_VALUES = 1 << 21


def _matrix(rows: pa.Table, name: str) -> np.ndarray:
    column = rows.column(name)
    return column.combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def _as_matrix(series: pd.Series) -> np.ndarray:
    if len(series) == 0:
        return np.zeros((0, 0))
    return np.stack([np.asarray(v, dtype=np.float64) for v in series.to_numpy()])


def _least_ids(p: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Rows that can be neighbours: of equal rows those with the k least ids."""
    if len(p) <= k:
        return np.arange(len(p))
    whole = np.ascontiguousarray(p + 0.0).view(np.dtype((np.void, 8 * p.shape[1]))).ravel()
    _, group, sizes = np.unique(whole, return_inverse=True, return_counts=True)
    if sizes.max() <= k:
        return np.arange(len(p))
    by_id = np.argsort(ids, kind="stable")
    order = by_id[np.argsort(group[by_id], kind="stable")]
    place = np.arange(len(p)) - np.searchsorted(group[order], group[order], side="left")
    return np.sort(order[place < k])


def _topk_in_steps(q: np.ndarray, p: np.ndarray, ids: np.ndarray, k: int):
    """Exact ``min(k, len(p))`` nearest of every row of ``q`` among ``p``, ordered by
    (round(d, 9), id).

    Yields (row index, reference index, distance) arrays, row after row, for slices of ``q``.
    """
    k = min(k, len(p))
    held = _least_ids(p, ids, k)
    p, ids = (p, ids) if len(held) == len(p) else (p[held], ids[held])
    for rows, cols in near_pairs(q, p, k, TIE, TASK_MATRIX_CELLS):
        diff = q[rows] - p[cols]
        dist = np.sqrt(np.einsum("ij,ij->i", diff, diff))
        by_id = np.argsort(ids[cols], kind="stable")
        rows, cols, dist = rows[by_id], cols[by_id], dist[by_id]
        order = np.lexsort((np.round(dist, 9), rows))
        rows, cols, dist = rows[order], cols[order], dist[order]
        place = np.arange(len(rows)) - np.searchsorted(rows, rows, side="left")
        best = place < k
        yield rows[best], held[cols[best]], dist[best]


def _checked(vec: Column, dim: int, side: str) -> Column:
    """The vector, or a clear error for a null, ragged or partly null one."""
    whole = vec.isNotNull() & (F.size(vec) == dim) & ~F.exists(vec, lambda x: x.isNull() | F.isnan(x))
    message = F.format_string(f"{side} vector needs {dim} numbers, found %s", vec.cast("string"))
    return F.when(F.coalesce(whole, F.lit(False)), vec).otherwise(F.raise_error(F.coalesce(message, F.lit(f"null {side} vector"))))


def _broadcast_parts(refd: DataFrame, carry: list):
    """The reference as arrays, shipped once per executor; its size is checked by the caller."""
    pdf = refd.toPandas()
    parts = (pdf["_rid"].to_numpy(), _as_matrix(pdf["_rv"]), {c: pdf[f"_c_{c}"].to_numpy(dtype=object) for c in carry})
    return refd.sparkSession.sparkContext.broadcast(parts)


def _knn_broadcast(qd: DataFrame, refd: DataFrame, k: int, query_id: str, carry: list) -> DataFrame:
    bc = _broadcast_parts(refd, carry)
    fields = [
        T.StructField(query_id, qd.schema["_qid"].dataType),
        T.StructField("nn_id", refd.schema["_rid"].dataType),
        T.StructField("distance", T.DoubleType()),
        T.StructField("nn_rank", T.IntegerType()),
    ] + [T.StructField(c, refd.schema[f"_c_{c}"].dataType) for c in carry]

    def run(batches):
        ids, p, cv = bc.value
        for pdf in batches:
            if len(pdf) == 0:
                continue
            qids = pdf["_qid"].to_numpy()
            for r, c, dist in _topk_in_steps(_as_matrix(pdf["_qv"]), p, ids, k):
                out = {
                    query_id: qids[r],
                    "nn_id": ids[c],
                    "distance": dist,
                    "nn_rank": (np.arange(len(r)) % k + 1).astype(np.int32),
                }
                for name in cv:
                    out[name] = cv[name][c]
                yield pd.DataFrame(out)

    return qd.mapInPandas(run, T.StructType(fields))


def _knn_blocks(qd: DataFrame, refd: DataFrame, k: int, query_id: str, carry: list, tiles: tuple[int, int]) -> DataFrame:
    """All pairs of query and reference tiles, then the k best per query row."""
    q_tiles, r_tiles = tiles
    # the vector is hashed too, so rows that share an id do not share a tile
    q_side = qd.withColumn("_qt", F.pmod(F.xxhash64("_qid", "_qv"), F.lit(q_tiles)).cast("int")).withColumn(
        "_rt", F.explode(F.sequence(F.lit(0), F.lit(r_tiles - 1)))
    )
    r_side = refd.withColumn("_rt", F.pmod(F.xxhash64("_rid", "_rv"), F.lit(r_tiles)).cast("int")).withColumn(
        "_qt", F.explode(F.sequence(F.lit(0), F.lit(q_tiles - 1)))
    )
    fields = [
        T.StructField("_qid", qd.schema["_qid"].dataType),
        T.StructField("_nn", refd.schema["_rid"].dataType),
        T.StructField("_d", T.DoubleType()),
    ] + [T.StructField(f"_c_{c}", refd.schema[f"_c_{c}"].dataType) for c in carry]

    names = [f.name for f in fields]

    def tile_topk(q: pa.Table, r: pa.Table) -> pa.Table:
        near = list(_topk_in_steps(_matrix(q, "_qv"), _matrix(r, "_rv"), r.column("_rid").to_numpy(), k)) if q.num_rows and r.num_rows else []
        rows, cols, dist = (np.concatenate(x) for x in zip(*near, strict=True)) if near else (np.zeros(0, np.int64),) * 2 + (np.zeros(0),)
        rows, cols = pa.array(rows, pa.int64()), pa.array(cols, pa.int64())
        carried = [r.column(f"_c_{c}").take(cols) for c in carry]
        return pa.table([q.column("_qid").take(rows), r.column("_rid").take(cols), pa.array(dist, pa.float64()), *carried], names)

    keys = ["_qt", "_rt"]
    cands = q_side.groupBy(*keys).cogroup(r_side.groupBy(*keys)).applyInArrow(tile_topk, T.StructType(fields))
    w = Window.partitionBy("_qid").orderBy(F.round("_d", 9), F.col("_nn"))
    return (
        cands.withColumn("nn_rank", F.row_number().over(w))
        .where(F.col("nn_rank") <= k)
        .select(
            F.col("_qid").alias(query_id),
            F.col("_nn").alias("nn_id"),
            F.col("_d").alias("distance"),
            F.col("nn_rank").cast("int").alias("nn_rank"),
            *[F.col(f"_c_{c}").alias(c) for c in carry],
        )
    )


def _sides(query: DataFrame, ref: DataFrame, k: int, query_id, ref_id, query_vec, ref_vec, carry, method):
    """Both sides with checked vectors, the reference's rows and dimension, and whether to broadcast it."""
    if k < 1:
        raise ValueError("k must be at least 1")
    if method not in ("auto", "broadcast", "blocks", "quantised"):
        raise ValueError(f"unknown method {method}")
    ship_package(query.sparkSession)
    raw = ref.select(
        F.col(ref_id).alias("_rid"),
        F.col(ref_vec).cast("array<double>").alias("_rv"),
        *[F.col(c).alias(f"_c_{c}") for c in carry],
    )
    text = [F.coalesce(F.length(F.col(c).cast("string")), F.lit(0)) for c in raw.columns if c != "_rv"]
    size = raw.agg(
        F.count(F.lit(1)).alias("n"), F.max(F.size("_rv")).alias("d"), F.sum(sum(text[1:], text[0])).alias("other")
    ).first()
    n_ref, dim = int(size["n"]), int(size["d"] or 0)
    if n_ref < k:
        raise ValueError(f"k={k} is larger than the {n_ref} reference rows")
    refd = raw.withColumn("_rv", _checked(F.col("_rv"), dim, "reference"))
    qv = F.col(query_vec).cast("array<double>")
    qd = query.select(F.col(query_id).alias("_qid"), _checked(qv, dim, "query").alias("_qv"))
    small = 8 * n_ref * dim + 4 * int(size["other"] or 0) <= BROADCAST_BYTES
    return qd, refd, n_ref, dim, method == "broadcast" or (method == "auto" and small)


def knn_join(
    query: DataFrame,
    ref: DataFrame,
    k: int,
    query_id: str,
    ref_id: str,
    query_vec: str = "features",
    ref_vec: str = "features",
    carry: Sequence[str] = (),
    block_rows: int = BLOCK_ROWS,
    query_rows_per_group: int = QUERY_ROWS_PER_GROUP,
    method: str = "auto",
) -> DataFrame:
    """For every query row, its ``k`` nearest reference rows.

    ``method='auto'`` broadcasts the reference when its counted size is at most
    ``BROADCAST_BYTES``, and otherwise uses the quantised plan; ``'blocks'`` is the plain
    tile plan. All give the same rows.

    Returns ``(query_id, nn_id, distance, nn_rank, *carry)`` where ``nn_id`` is the
    reference id and ``carry`` are reference columns passed through (J4). A row that
    is in both inputs counts as its own neighbour (J3). Query ids must be unique. Raises
    ``ValueError`` when the reference has fewer than ``k`` rows; a null, ragged or partly
    null vector fails the job with a message that says so.
    """
    carry = list(carry)
    qd, refd, n_ref, dim, small = _sides(query, ref, k, query_id, ref_id, query_vec, ref_vec, carry, method)
    if small:
        return checkpoint(_knn_broadcast(qd, refd, k, query_id, carry))
    rows = max(1, TILE_VALUES // max(1, dim))
    if method in ("auto", "quantised") and dim:
        return checkpoint(knn_quantised(qd, refd, k, query_id, carry, n_ref, dim, min(block_rows, query_rows_per_group, rows), rows))
    n_query = query.count()
    r_tiles = max(1, math.ceil(n_ref / tile_rows(block_rows, n_ref, rows)))
    q_tiles = max(1, math.ceil(n_query / tile_rows(query_rows_per_group, n_query, rows)))
    # |query| x k rows that callers read more than once: cut the lineage here
    return checkpoint(_knn_blocks(qd, refd, k, query_id, carry, (q_tiles, r_tiles)))


def mean_knn_distance(
    query: DataFrame, ref: DataFrame, k: int, id_col: str, vec_col: str = "features", **kw
) -> DataFrame:
    """Mean distance of each query row to its ``k`` nearest reference rows.

    With a small reference the mean is taken in the task that finds the neighbours: no
    rows per neighbour, no shuffle."""
    qd, refd, _, _, small = _sides(query, ref, k, id_col, id_col, vec_col, vec_col, [], kw.get("method", "auto"))
    if not small:
        nn = knn_join(query, ref, k, id_col, id_col, vec_col, vec_col, **kw)
        return nn.groupBy(id_col).agg(F.avg("distance").alias("mean_dist"))
    bc = _broadcast_parts(refd, [])
    schema = T.StructType([T.StructField(id_col, qd.schema["_qid"].dataType), T.StructField("mean_dist", T.DoubleType())])

    def run(batches):
        ids, p, _ = bc.value
        for pdf in batches:
            if len(pdf):
                found = _topk_in_steps(_as_matrix(pdf["_qv"]), p, ids, k)
                means = np.concatenate([dist.reshape(-1, k).mean(axis=1) for _, _, dist in found])
                yield pd.DataFrame({id_col: pdf["_qid"].to_numpy(), "mean_dist": means})

    return qd.mapInPandas(run, schema)


def credibility(
    df: DataFrame, k: int, id_col: str, vec_col: str = "features", y_col: str = "y_pu", **kw
) -> DataFrame:
    """Share of known positives among the ``k`` nearest rows, the row itself included,
    for unlabeled rows only (J3, J4, A10)."""
    # known positives are neighbours, but nothing is asked about them
    asked = df.join(df.where(F.col(y_col) == 0).select(id_col), id_col, "left_semi")
    nn = knn_join(asked, df, k, id_col, id_col, vec_col, vec_col, carry=[y_col], **kw)
    return nn.groupBy(id_col).agg(F.avg(F.col(y_col).cast("double")).alias("credibility"))


def knn_classify(
    train: DataFrame,
    test: DataFrame,
    k: int,
    id_col: str,
    vec_col: str = "features",
    y_col: str = "y",
    **kw,
) -> DataFrame:
    """k-nearest-neighbour classifier: vote share of class 1 and majority label."""
    nn = knn_join(test, train, k, id_col, id_col, vec_col, vec_col, carry=[y_col], **kw)
    return (
        nn.groupBy(id_col)
        .agg(F.avg(F.col(y_col).cast("double")).alias("vote_share"))
        .withColumn("prediction", (F.col("vote_share") > 0.5).cast("int"))
    )
