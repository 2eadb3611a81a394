"""Exact ranks, running totals and top-n cuts without a one-task window.

A ``Window.orderBy`` without ``partitionBy`` sorts every row in a single task. The
functions here split the order into buckets first:

* ``hash_rank``  - rank by an md5 key. md5 is uniform, so a fixed number of leading
  hex digits gives equal-sized buckets whatever the data; counts per bucket are a
  small table whose running sum is the offset of each bucket.
* ``prefix_sums`` - running sums over a key that is unique within its group (for
  example distinct scores after a pre-aggregation). Buckets are the partitions of a
  range partitioning on the key itself, whatever its type, balanced precisely because
  the key is unique.
* ``top_n``     - the first ``n`` rows by (score, id). Rows are first counted per
  distinct score (a hot tie group is a single pre-aggregated row), the cut score is
  found by a running count, and only the rows tied at the cut are ranked by id.

Each per-bucket table holds at most ``groups x buckets`` rows; it is broadcast only
when that bound is under ``BROADCAST_ROWS``.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize

# Rows per bucket a single task sorts; bounded independent of the table size.
ROWS_PER_BUCKET = 1 << 20
# Below this many rows per bucket, more buckets only add overhead.
MIN_ROWS_PER_BUCKET = 1 << 18
# Largest per-bucket table that is broadcast rather than shuffled.
BROADCAST_ROWS = 2_000_000


def _cols(by) -> list[str]:
    if by is None:
        return []
    if isinstance(by, str):
        return [by]
    return list(by)


def _maybe_broadcast(df: DataFrame, bound: int) -> DataFrame:
    return F.broadcast(df) if bound <= BROADCAST_ROWS else df


def _join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi-join on ``keys`` with null-safe equality, so a null group key or score
    keeps its rows (still planned as a hash or sort-merge join)."""
    keys = list(keys)
    r = right.select(*[F.col(k).alias(f"_rk_{k}") for k in keys], *[c for c in right.columns if c not in keys])
    cond = None
    for k in keys:
        c = left[k].eqNullSafe(r[f"_rk_{k}"])
        cond = c if cond is None else cond & c
    return left.join(r, cond, how).drop(*[f"_rk_{k}" for k in keys])


def _parallelism(df: DataFrame) -> int:
    try:
        return int(df.sparkSession.sparkContext.defaultParallelism)
    except Exception:
        return 8


def hex_digits_for(n_rows: int, rows_per_bucket: int | None = None, parallelism: int = 8) -> int:
    """Leading md5 hex digits so that ``n_rows / 16**h <= rows_per_bucket`` and, for
    large inputs, there are at least ``2 x parallelism`` buckets."""
    rows_per_bucket = rows_per_bucket or ROWS_PER_BUCKET
    need = max(1.0, n_rows / rows_per_bucket)
    if n_rows > MIN_ROWS_PER_BUCKET:
        need = max(need, min(2 * parallelism, n_rows / MIN_ROWS_PER_BUCKET))
    return max(1, min(7, math.ceil(math.log(need, 16)))) if need > 1 else 1


def hash_rank(
    df: DataFrame,
    key: str,
    id_col: str,
    by: Sequence[str] | str | None = (),
    rank_col: str = "rank",
    n_rows: int | None = None,
) -> DataFrame:
    """1-based rank of each row by (``key``, ``id_col``) within ``by``.

    ``key`` must be an md5 hex column (see ``functions.md5_key``). ``n_rows`` is an
    upper bound of the largest group; it is counted when not given.
    """
    by = _cols(by)
    if n_rows is None:
        n_rows = df.count()
    h = hex_digits_for(n_rows, parallelism=_parallelism(df))
    bucket = F.conv(F.substring(F.col(key), 1, h), 16, 10).cast("long")
    with_b = df.withColumn("_bucket", bucket)
    counts = with_b.groupBy(*by, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    w_off = Window.partitionBy(*by).orderBy("_bucket").rowsBetween(
        Window.unboundedPreceding, -1
    )
    offsets = counts.select(
        *by, "_bucket", F.coalesce(F.sum("_n").over(w_off), F.lit(0)).alias("_offset")
    )
    # 16**h rows without groups: broadcast under the bound; with groups the size is
    # groups x 16**h, so AQE's runtime size check picks the join
    if not by:
        offsets = _maybe_broadcast(offsets, 16**h)
    w_in = Window.partitionBy(*by, "_bucket").orderBy(F.col(key), F.col(id_col))
    return (
        _join(with_b, offsets, [*by, "_bucket"])
        .withColumn(rank_col, (F.col("_offset") + F.row_number().over(w_in)).cast("long"))
        .drop("_bucket", "_offset")
    )


def _range_buckets(df: DataFrame, by: list[str], order: Column, n_rows: int, out: str) -> tuple[DataFrame, int]:
    """Contiguous buckets of (``by``, ``order``): the partitions of a range partitioning.

    Spark samples the keys in their own type, so text, decimals and large integers are
    ordered as they are, in either direction. Written out once, since a partition number
    must not change between the totals and the rows.
    """
    nb = max(1, math.ceil(n_rows / ROWS_PER_BUCKET))
    if n_rows > MIN_ROWS_PER_BUCKET:
        nb = max(nb, min(2 * _parallelism(df), math.ceil(n_rows / MIN_ROWS_PER_BUCKET)))
    if nb == 1:
        return df.withColumn(out, F.lit(0)), 1
    dealt = df.repartitionByRange(nb, *[F.col(c) for c in by], order).withColumn(out, F.spark_partition_id())
    return materialize(dealt, "range-buckets"), nb


def prefix_sums(
    df: DataFrame,
    order: str,
    values: Sequence[str],
    by: Sequence[str] | str | None = (),
    descending: bool = False,
    n_rows: int | None = None,
    max_group: int | None = None,
    totals_too: bool = False,
) -> DataFrame:
    """Add ``{v}_before`` = sum of ``v`` over rows earlier in ``order`` within ``by``, and
    with ``totals_too`` ``{v}_total``, the sum over all rows of the group, which the same
    bucket totals give.

    ``order`` must be unique within each ``by`` group and not null; it may have any
    orderable type. Rows are split into range buckets of about ``ROWS_PER_BUCKET`` rows
    (when the largest group has more); per-bucket totals give the offset, a window
    inside (group, bucket) gives the rest. ``n_rows`` (used without groups) bounds the
    row count and is counted when not given; ``max_group`` bounds the largest group and
    saves the job that finds it. The bounds choose how the work is split, never what
    is returned.
    """
    by = _cols(by)
    values = list(values)
    work = df
    order_key = F.col(order).desc() if descending else F.col(order).asc()
    if by:
        # buckets only need to split the largest group: many small groups already
        # spread over tasks through the window partitioning
        if max_group is not None:
            n_rows = max_group
        else:
            n_rows = work.groupBy(*by).count().agg(F.max("count")).first()[0] or 0
    elif n_rows is None:
        n_rows = work.count()
    work, nb = _range_buckets(work, by, order_key, n_rows, "_pb")
    w_in = Window.partitionBy(*by, "_pb").orderBy(order_key).rowsBetween(
        Window.unboundedPreceding, -1
    )
    if nb == 1:
        out = work
        for v in values:
            out = out.withColumn(
                f"{v}_before", F.coalesce(F.sum(v).over(w_in), F.lit(0))
            )
            if totals_too:
                out = out.withColumn(f"{v}_total", F.sum(v).over(Window.partitionBy(*by, "_pb")))
    else:
        totals = work.groupBy(*by, "_pb").agg(*[F.sum(v).alias(f"_t_{v}") for v in values])
        w_off = Window.partitionBy(*by).orderBy("_pb").rowsBetween(
            Window.unboundedPreceding, -1
        )
        offsets = totals.select(
            *by,
            "_pb",
            *[F.coalesce(F.sum(f"_t_{v}").over(w_off), F.lit(0)).alias(f"_o_{v}") for v in values],
            *[F.sum(f"_t_{v}").over(Window.partitionBy(*by)).alias(f"{v}_total") for v in values if totals_too],
        )
        # without groups the table has nb rows: broadcast; with groups its size is
        # groups x nb, unknown here, so the join strategy is left to AQE's size check
        offsets = _maybe_broadcast(offsets, nb) if not by else offsets
        out = _join(work, offsets, [*by, "_pb"])
        for v in values:
            out = out.withColumn(
                f"{v}_before",
                F.col(f"_o_{v}") + F.coalesce(F.sum(v).over(w_in), F.lit(0)),
            ).drop(f"_o_{v}")
    return out.drop("_pb")


def top_n(
    df: DataFrame,
    score: str,
    id_col: str,
    n: int | Column | str,
    by: Sequence[str] | str | None = (),
    descending: bool = True,
    flag: str = "selected",
    n_rows: int | None = None,
) -> DataFrame:
    """Flag the first ``n`` rows of each group ordered by ``score`` then ``id_col``.

    ``n`` is an int, or the name of a column carrying the per-group amount. Ties are
    broken by ascending id in both directions (N5). Returns ``df`` + ``flag`` (bool).
    ``n_rows`` bounds the input size (counted when not given). ``df`` is read three
    times: materialize it first when it is expensive to recompute.
    """
    by = _cols(by)
    if n_rows is None:
        n_rows = df.count()
    amount = F.col(n) if isinstance(n, str) else (n if isinstance(n, Column) else F.lit(int(n)))
    base = df.withColumn("_amount", amount.cast("long"))
    # rows without a score are kept but never selected
    per_score = base.where(F.col(score).isNotNull()).groupBy(*by, score).agg(
        F.count(F.lit(1)).alias("_cnt"), F.first("_amount").alias("_amount")
    )
    # distinct scores and tied rows are both bounded by the row count
    per_score = prefix_sums(per_score, score, ["_cnt"], by=by, descending=descending, n_rows=n_rows)
    per_score = per_score.withColumn(
        "_state",
        F.when(F.col("_cnt_before") + F.col("_cnt") <= F.col("_amount"), F.lit(2))
        .when(F.col("_cnt_before") < F.col("_amount"), F.lit(1))
        .otherwise(F.lit(0)),
    ).withColumn("_rest", F.col("_amount") - F.col("_cnt_before"))
    states = per_score.select(*by, score, "_state", "_rest")
    # rows without a score never join: a hot null score moves nowhere
    scored, unscored = base.drop("_amount").where(F.col(score).isNotNull()), base.drop("_amount").where(F.col(score).isNull())
    tagged = _join(scored, states, [*by, score], "left").unionByName(unscored, allowMissingColumns=True)
    # rows tied at the cut score: rank by id (unique within the tie group)
    cut = tagged.where(F.col("_state") == 1).withColumn("_one", F.lit(1))
    cut = prefix_sums(cut, id_col, ["_one"], by=[*by, score], max_group=n_rows)
    cut_ids = cut.where(F.col("_one_before") < F.col("_rest")).select(*by, id_col).withColumn(
        "_tie_in", F.lit(True)
    )
    out = _join(tagged, cut_ids, [*by, id_col], "left")
    out = out.withColumn(
        flag,
        F.coalesce(
            (F.col("_state") == 2) | ((F.col("_state") == 1) & F.coalesce(F.col("_tie_in"), F.lit(False))),
            F.lit(False),
        ),
    )
    return out.drop("_state", "_rest", "_tie_in")


def global_rank(
    df: DataFrame,
    score: str,
    id_col: str,
    by: Sequence[str] | str | None = (),
    descending: bool = False,
    rank_col: str = "rank",
) -> DataFrame:
    """Exact 1-based position by (``score``, ``id_col``) within ``by``.

    position = rows with an earlier score (running count over distinct scores)
    + rank of the id inside its tie group (running count over ids).
    """
    by = _cols(by)
    per_score = df.where(F.col(score).isNotNull()).groupBy(*by, score).agg(F.count(F.lit(1)).alias("_cnt"))
    per_score = prefix_sums(per_score, score, ["_cnt"], by=by, descending=descending)
    # rows without a score keep a null rank
    tagged = _join(df, per_score.select(*by, score, "_cnt_before"), [*by, score], "left")
    tagged = tagged.withColumn("_one", F.lit(1))
    tagged = prefix_sums(tagged, id_col, ["_one"], by=[*by, score])
    return tagged.withColumn(
        rank_col, (F.col("_cnt_before") + F.col("_one_before") + 1).cast("long")
    ).drop("_cnt_before", "_one_before", "_one")


def tail_cuts(
    df: DataFrame,
    score: str,
    id_col: str,
    frac: float,
    by: Sequence[str] | str | None = (),
    n_rows: int | None = None,
) -> DataFrame:
    """Flag the lowest and highest ``floor(frac * n)`` rows per group.

    Adds ``low`` and ``high`` booleans. One running count over the distinct scores
    serves both tails (rows above a score = total - rows below - rows at it), and one
    id ranking serves the rows tied at either cut. Ties go to the smaller id in both
    directions. With ``frac <= 0.5`` the tails are disjoint. ``n`` counts the rows with
    a score; rows without one are in neither tail. ``n_rows`` only bounds the input size.
    """
    by = _cols(by)
    scored = df.where(F.col(score).isNotNull())
    per_score = scored.groupBy(*by, score).agg(F.count(F.lit(1)).alias("_cnt"))
    # the total is that of the scored rows, with and without groups
    if by:
        n = df.count() if n_rows is None else n_rows
        sizes = scored.groupBy(*by).agg(F.count(F.lit(1)).alias("_tot"))
        per_score = _join(per_score, sizes, by)  # any number of groups: AQE picks the join
    else:
        n = scored.count()
        per_score = per_score.withColumn("_tot", F.lit(int(n)).cast("long"))
    per_score = prefix_sums(per_score, score, ["_cnt"], by=by, n_rows=n)
    m = F.floor(F.col("_tot") * F.lit(float(frac)))
    asc = F.col("_cnt_before")
    desc = F.col("_tot") - F.col("_cnt_before") - F.col("_cnt")

    def state(before):
        return (
            F.when(before + F.col("_cnt") <= m, F.lit(2)).when(before < m, F.lit(1)).otherwise(F.lit(0))
        )

    states = per_score.select(
        *by, score,
        state(asc).alias("_ls"), (m - asc).alias("_lr"),
        state(desc).alias("_hs"), (m - desc).alias("_hr"),
    )
    tagged = _join(df, states, [*by, score], "left")
    cut = tagged.where((F.col("_ls") == 1) | (F.col("_hs") == 1)).select(*by, score, id_col).withColumn("_one", F.lit(1))
    cut = prefix_sums(cut, id_col, ["_one"], by=[*by, score], max_group=n).select(*by, id_col, "_one_before")
    out = _join(tagged, cut, [*by, id_col], "left")
    tie_rank = F.coalesce(F.col("_one_before"), F.lit(-1))
    low = (F.col("_ls") == 2) | ((F.col("_ls") == 1) & (tie_rank >= 0) & (tie_rank < F.col("_lr")))
    high = (F.col("_hs") == 2) | ((F.col("_hs") == 1) & (tie_rank >= 0) & (tie_rank < F.col("_hr")))
    out = out.withColumn("low", F.coalesce(low, F.lit(False))).withColumn("high", F.coalesce(high, F.lit(False)))
    return out.drop("_ls", "_lr", "_hs", "_hr", "_one_before")
