"""Result-table operators: pivots, widening, comparisons, grids, quantiles, column
utilities (A15-A20, A22, A23, J5, J7-J13, U1-U4, P4-P11).

A result table is long: one row per (method, setting, ...) with metric columns.
Pivots take their column values explicitly or from one ``distinct`` pass; the number
of output columns is bounded by design, so the value list is small.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import md5_key
from ..session import materialize, ship_package
from .ranking import prefix_sums
from .splits import DEFAULT_SEED

FEATURE_MARK = "__feature__"
# Widest pivot result accepted (its column names pass through the driver).
MAX_PIVOT_COLUMNS = 10_000


# ----------------------------------------------------------------------------- columns

def keep_features(df: DataFrame, mark: str = FEATURE_MARK) -> DataFrame:
    """Keep the columns whose name contains ``__feature__``."""
    return df.select(*[c for c in df.columns if mark in c])


def to_wide(df: DataFrame, vec_col: str, dim: int, keep: Sequence[str] = (), prefix: str = FEATURE_MARK) -> DataFrame:
    """Vector -> ``__feature__0 ... __feature__{dim-1}`` columns (P5)."""
    return df.select(*keep, *[F.col(vec_col)[i].alias(f"{prefix}{i}") for i in range(dim)])


def to_vector(df: DataFrame, out: str = "features", keep: Sequence[str] = (), mark: str = FEATURE_MARK) -> DataFrame:
    """Wide feature columns -> one ``array<double>`` in index order (P5)."""
    cols = sorted((c for c in df.columns if mark in c), key=lambda c: int(c.split(mark)[-1]))
    return df.select(*keep, F.array(*[F.col(c).cast("double") for c in cols]).alias(out))


def drop_columns(df: DataFrame, cols: Iterable[str]) -> DataFrame:
    """Drop the listed columns, ignoring absent ones."""
    return df.drop(*[c for c in cols if c in df.columns])


def suffix_metrics(df: DataFrame, metrics: Iterable[str], suffix: str) -> DataFrame:
    """Rename ``metric`` -> ``metric_{suffix}``."""
    return df.withColumnsRenamed({m: f"{m}_{suffix}" for m in metrics if m in df.columns})


def select_prefix(df: DataFrame, prefix: str, keep: Sequence[str] = ()) -> DataFrame:
    """Columns starting with ``prefix``."""
    return df.select(*keep, *[c for c in df.columns if c.startswith(prefix) and c not in keep])


def with_literal(df: DataFrame, name: str, value, first: bool = True) -> DataFrame:
    """Insert a literal column, first by default."""
    out = df.withColumn(name, F.lit(value))
    return out.select(name, *df.columns) if first else out


def decode(col: str | Column, mapping: dict) -> Column:
    """Code -> name by a fixed dictionary; a missing key gives null."""
    c = F.col(col) if isinstance(col, str) else col
    m = F.create_map(*[x for k, v in mapping.items() for x in (F.lit(k), F.lit(v))])
    return F.try_element_at(m, c)


def unique_columns(names: Iterable[str]) -> list[str]:
    """First occurrence of each column name."""
    seen, out = set(), []
    for n in names:
        if n not in seen:
            seen.add(n)
            out.append(n)
    return out


# ----------------------------------------------------------------------------- sets

def stack(frames: Sequence[DataFrame]) -> DataFrame:
    """Stack rows by column name."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def remove(df: DataFrame, ids: DataFrame, id_col: str) -> DataFrame:
    """Rows of ``df`` whose id is not in ``ids``."""
    return df.join(ids.select(id_col), id_col, "left_anti")


def distinct_values(df: DataFrame, col: str) -> DataFrame:
    """Distinct values of a column."""
    return df.select(col).distinct()


# ----------------------------------------------------------------------------- pivots

def check_unique(df: DataFrame, keys: Sequence[str]) -> None:
    """Raise like pandas when the pivot keys repeat."""
    dup = df.groupBy(*keys).count().where("count > 1").limit(1).collect()
    if dup:
        raise ValueError(f"Index contains duplicate entries, cannot reshape: {dup[0].asDict()}")


def pivot_results(
    df: DataFrame,
    index: str | Sequence[str],
    columns: str | Sequence[str],
    value: str,
    values: Sequence | None = None,
    strict: bool = True,
    name_fmt=None,
) -> DataFrame:
    """Long -> wide.

    One axis pivots on its values. Several axes pivot on a flattened tuple name,
    ``"(5.386517, 'logistic', 'knn')"`` by default, as pandas' ``to_flat_index``
    prints it. ``strict`` raises on duplicate keys as pandas does.
    """
    index = [index] if isinstance(index, str) else list(index)
    columns = [columns] if isinstance(columns, str) else list(columns)
    if strict or values is None:
        # the check, the names and the pivot read a result table computed once
        df = materialize(df, "pivot")
    if strict:
        check_unique(df, index + columns)
    if len(columns) == 1:
        key = F.col(columns[0]).cast("string")
    else:
        fmt = name_fmt or _tuple_name
        key = fmt([F.col(c) for c in columns], [df.schema[c].dataType.simpleString() for c in columns])
    keyed = df.withColumn("_pk", key)
    if values is None:
        # the column names of the result: bounded by design, checked before collecting
        found = keyed.select("_pk").distinct().orderBy("_pk").limit(MAX_PIVOT_COLUMNS + 1).collect()
        if len(found) > MAX_PIVOT_COLUMNS:
            raise ValueError(f"pivot would create more than {MAX_PIVOT_COLUMNS} columns")
        values = [r["_pk"] for r in found]
    return keyed.groupBy(*index).pivot("_pk", list(values)).agg(F.first(value))


def _tuple_name(cols: list[Column], types: list[str]) -> Column:
    parts = []
    for c, t in zip(cols, types):
        if t == "string":
            parts.append(F.concat(F.lit("'"), c, F.lit("'")))
        else:
            parts.append(c.cast("string"))
    inner = [parts[0]]
    for p in parts[1:]:
        inner += [F.lit(", "), p]
    return F.concat(F.lit("("), *inner, F.lit(")"))


def widen_by_setting(frames: dict[str, DataFrame], key: str, metrics: Sequence[str], drop: Sequence[str] = ()) -> DataFrame:
    """One metric column per setting, joined on ``key`` (J7 + P6 + P7 + U3).

    The reference pastes frames side by side by position; a full join on the key
    is the order-independent form.
    """
    out = None
    for setting, df in frames.items():
        d = suffix_metrics(drop_columns(df, drop), metrics, setting)
        d = d.select(*unique_columns(d.columns))
        if out is not None:
            # a column already present keeps its first occurrence
            d = d.select(key, *[c for c in d.columns if c != key and c not in out.columns])
        out = d if out is None else out.join(d, key, "full")
    return out


# ----------------------------------------------------------------------------- comparisons

def metric_fall(df: DataFrame, key: str, setting_col: str, metric: str, pairs, template: str, label_col: str = "train_ds") -> DataFrame:
    """Relative fall ``round((1 - different/same) * 100, 2)`` per key.

    ``pairs`` is a list of ``((train, other_test), (train, same_test))`` tuples that
    are formatted with ``template`` into setting names.
    """
    from ..functions.columns import round_even

    wanted = df.sparkSession.createDataFrame(
        [(diff[0], template.format(*diff), template.format(*same)) for diff, same in pairs],
        f"{label_col} string, _diff string, _same string",
    )
    # one join for all pairs, on the setting names
    d = df.select(F.col(setting_col).alias("_diff"), key, F.col(metric).alias("_d"))
    s = df.select(F.col(setting_col).alias("_same"), key, F.col(metric).alias("_s"))
    fall = round_even((F.lit(1.0) - F.col("_d") / F.col("_s")) * 100, 2).alias("fall")
    return wanted.join(d, "_diff").join(s, ["_same", key]).select(label_col, key, fall)


def with_baseline(df: DataFrame, base: DataFrame, keys: Sequence[str], metric: str, out: str = "baseline") -> DataFrame:
    """Attach the baseline metric of the same (setting, classifier)."""
    b = base.select(*keys, F.col(metric).alias(out))
    return df.join(b, list(keys), "left")


def metric_by_k(df: DataFrame, k_col: str, metric: str) -> DataFrame:
    """Mean, sample standard deviation and count of a metric per k."""
    return df.groupBy(k_col).agg(
        F.avg(metric).alias("mean"), F.stddev_samp(metric).alias("std"), F.count(F.lit(1)).alias("n")
    )


# Hex digits of a bootstrap uniform: one md5 key serves four replicates.
BOOTSTRAP_DIGITS = 8


def poisson_one_cdf() -> list[float]:
    """``P(X <= n)`` of a Poisson variable of mean 1, as far as uniforms of 32 bits reach."""
    out, term, total = [], math.exp(-1.0), 0.0
    while total < 1 - 2.0 ** (-4 * BOOTSTRAP_DIGITS):
        total += term
        out.append(total)
        term /= len(out)
    return out


def bootstrap_weight(uniform: Column) -> Column:
    """How often a row is drawn: the number of Poisson(1) steps at or below ``uniform``."""
    weight = F.lit(0)
    for step in poisson_one_cdf():
        weight = weight + (uniform >= F.lit(step)).cast("int")
    return weight


def _drawn(replicates: int):
    """Sums of weight and of weight times metric per k and replicate of the rows of a batch."""
    steps = np.array(poisson_one_cdf())

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            coded = batch.column("k").dictionary_encode(null_encoding="encode")
            code = coded.indices.to_numpy()
            order = np.argsort(code, kind="stable")
            starts = np.flatnonzero(np.diff(code[order], prepend=-1))
            digits = bytes.fromhex("".join(batch.column("hex").to_pylist()))
            drawn = np.frombuffer(digits, ">u4").reshape(batch.num_rows, -1)[order, :replicates]
            weight = np.searchsorted(steps, drawn / 2.0 ** (4 * BOOTSTRAP_DIGITS), side="right")
            metric = batch.column("m").to_numpy()[order]
            n = np.add.reduceat(weight, starts, axis=0)
            with np.errstate(invalid="ignore"):
                total = np.add.reduceat(np.where(weight > 0, weight * metric[:, None], 0.0), starts, axis=0)
            group, b = np.nonzero(n)
            k = coded.dictionary.take(pa.array(code[order][starts][group]))
            yield pa.RecordBatch.from_arrays(
                [k, pa.array(b, pa.int32()), pa.array(total[group, b]), pa.array(n[group, b], pa.int64())], ["k", "_b", "_sum", "_n"]
            )

    return run


def bootstrap_band(
    df: DataFrame, k_col: str, metric: str, row_key: Sequence[str], replicates: int = 1000, level: float = 0.95,
    seed: int = DEFAULT_SEED,
) -> DataFrame:
    """``k, low, high``: the band that holds ``level`` of the bootstrap means of a metric per
    k (the shaded band of the k plot, A23).

    Poisson bootstrap: in replicate b a row counts as often as a Poisson(1) variable drawn
    from the md5 key of its ``row_key`` and b says, so rows need no numbering and no group
    is gathered. All replicates come from one scan: a row becomes its nonzero weights, which
    are summed per (k, replicate) batch by batch in the task, then before the shuffle; what is
    shuffled has at most one row per task, k and replicate. Replicates that draw no row of a k have no mean. Rows without
    a metric count for nothing; without ``row_key`` duplicates the rows draw independently.
    """
    ship_package(df.sparkSession)
    fours = F.sequence(F.lit(0), F.lit(math.ceil(replicates / 4) - 1))
    keys = F.transform(fours, lambda i: md5_key(seed, *row_key, i))
    whole = df.where(F.col(metric).cast("double").isNotNull() & md5_key(seed, *row_key).isNotNull())
    read = whole.select(F.col(k_col).alias("k"), F.col(metric).cast("double").alias("m"), F.array_join(keys, "").alias("hex"))
    schema = T.StructType([read.schema["k"]]).add("_b", T.IntegerType()).add("_sum", T.DoubleType()).add("_n", T.LongType())
    drawn = read.mapInArrow(_drawn(replicates), schema)
    means = drawn.groupBy(F.col("k").alias(k_col), "_b").agg((F.sum("_sum") / F.sum("_n")).alias("_mean"))
    tail = (1 - level) / 2
    return means.groupBy(k_col).agg(
        F.percentile("_mean", F.lit(tail)).alias("low"), F.percentile("_mean", F.lit(1 - tail)).alias("high")
    )


# ----------------------------------------------------------------------------- grids

# Most values an axis taken from a table may have (checked when the plan runs).
MAX_AXIS = 10_000


def axis(df: DataFrame, value, name: str) -> DataFrame:
    """The sorted distinct values of an expression as a one-row array column ``name``.

    Values are made distinct before they are gathered; more than ``MAX_AXIS`` are an error.
    """
    distinct = df.select((F.col(value) if isinstance(value, str) else value).alias(name)).distinct()
    gathered = distinct.agg(F.count(F.lit(1)).alias("_n"), F.collect_list(name).alias(name))
    message = F.format_string(f"axis {name} has %s values, at most {MAX_AXIS} are allowed", F.col("_n"))
    return gathered.select(F.when(F.col("_n") <= MAX_AXIS, F.array_sort(name)).otherwise(F.raise_error(message)).alias(name))


def _one_row(spark, axes: dict) -> DataFrame:
    """All axes as array columns of one row; an axis is a list or a one-row frame (``axis``)."""
    row = spark.range(1).select(F.lit(0).alias("_key"))
    for name, values in axes.items():
        if isinstance(values, DataFrame):
            # one row against one row, on a constant
            row = row.join(values.select(F.lit(0).alias("_key"), F.col(values.columns[0]).alias(name)), "_key")
        else:
            row = row.withColumn(name, F.array(*[F.lit(v) for v in values]))
    return row.drop("_key")


def grid(spark, **axes) -> DataFrame:
    """Cartesian parameter grid (J12), built in Spark by exploding one array per axis.

    An axis is a list (a parameter) or a one-row frame taken from a table (``axis``).
    """
    df = _one_row(spark, axes)
    for name in axes:
        df = df.withColumn(name, F.explode(name))
    return df


def zip_axes(spark, **axes) -> DataFrame:
    """Lock-step zip of axes (J13) with a 1-based ``pos``, truncated to the shortest; struct
    entries become their fields."""
    row = _one_row(spark, axes)
    shortest = F.least(*[F.size(n) for n in axes]) if len(axes) > 1 else F.size(next(iter(axes)))
    zipped = F.slice(F.arrays_zip(*axes), F.lit(1), shortest)
    out = row.select(F.posexplode(zipped).alias("_pos", "_at"))
    columns = []
    for name in axes:
        kind = row.schema[name].dataType.elementType
        columns += (
            [F.col(f"_at.{name}.{f}").alias(f) for f in kind.names] if hasattr(kind, "names") else [F.col(f"_at.{name}").alias(name)]
        )
    return out.select((F.col("_pos") + 1).cast("long").alias("pos"), *columns)


def pending_cells(grid_df: DataFrame, done: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Grid cells without a result yet."""
    return grid_df.join(done.select(*keys).distinct(), list(keys), "left_anti")


def match_vectors(df: DataFrame, probes: DataFrame, vec_col: str) -> DataFrame:
    """Rows whose vector equals some probe vector exactly."""
    p = probes.select(F.col(vec_col).cast("array<double>").alias("_pv")).distinct()
    return df.join(p, F.col(vec_col).cast("array<double>") == F.col("_pv"), "left_semi")


# ----------------------------------------------------------------------------- quantiles

#: accuracy of the sketch of the first scan: ranks are right to one part in so many
SKETCH_ACCURACY = 10_000


def exact_quantiles(df: DataFrame, col: str, probs: Sequence[float], accuracy: int = SKETCH_ACCURACY) -> DataFrame:
    """Exact linear-interpolated quantiles (A19), equal to ``quantile_cont``, in two scans.

    The first scan merges a rank sketch per task; its values a little below and above each
    probability bracket the quantile for certain, since ranks are right to ``1 / accuracy``.
    The second scan counts values, those outside all brackets as one count per gap, so that
    only about ``4 / accuracy`` of the values per probability are shuffled. A running count
    over that small table gives the values at the needed positions, two per probability.
    Should a bracket miss its position all the same, every value is counted.
    """
    spark = df.sparkSession
    vals = df.select(F.col(col).cast("double").alias("v")).where(F.col("v").isNotNull() & ~F.isnan("v"))
    empty = spark.createDataFrame([(float(p), None) for p in probs], "prob double, threshold double")
    if not probs:
        return empty
    room = 2.0 / accuracy
    edges = [min(max(e, 0.0), 1.0) for p in probs for e in (p - room, p + room)]
    told = vals.agg(
        F.count("v").alias("n"), F.percentile_approx("v", edges, accuracy).alias("e"), F.min("v").alias("a"), F.max("v").alias("b")
    ).first()
    n = told["n"]
    if not n:
        return empty
    # the sketch does not promise the extremes
    brackets = [
        (told["a"] if lo == 0.0 else told["e"][2 * i], told["b"] if hi == 1.0 else told["e"][2 * i + 1])
        for i, (lo, hi) in enumerate(zip(edges[::2], edges[1::2], strict=True))
    ]
    need = sorted({f((n - 1) * p) for p in probs for f in (math.floor, math.ceil)})
    found = _at_positions(_counted(vals, brackets), need, n)
    if set(found) != set(need):
        found = _at_positions(_counted(vals, [(told["a"], told["b"])]), need, n)
    rows = []
    for p in probs:
        h = (n - 1) * p
        low, high = found[math.floor(h)], found[math.ceil(h)]
        rows.append((float(p), low + (h - math.floor(h)) * (high - low)))
    return spark.createDataFrame(rows, "prob double, threshold double")


def _counted(vals: DataFrame, brackets: list[tuple[float, float]]) -> DataFrame:
    """``o, cnt``: how often each value inside a bracket occurs, and before each bracket
    the number of values in the gap; ``o`` (value, inside) is the order."""
    inside = F.lit(False)
    for lo, hi in brackets:
        inside = inside | F.col("v").between(lo, hi)
    starts = sorted({lo for lo, _ in brackets})
    gap = F.lit(float("inf"))  # above all brackets
    for lo in reversed(starts):
        gap = F.when(F.col("v") < lo, F.lit(lo)).otherwise(gap)
    key = F.struct(F.when(inside, F.col("v")).otherwise(gap).alias("v"), inside.alias("inside"))
    return vals.select(key.alias("o")).groupBy("o").agg(F.count(F.lit(1)).alias("cnt"))


def _at_positions(counted: DataFrame, need: list[int], n: int) -> dict[int, float]:
    """The values at the 0-based positions ``need``; a position in a gap has none."""
    counted = materialize(counted, "quantile-counts")
    ranked = prefix_sums(counted, "o", ["cnt"])
    positions = F.array(*[F.lit(i) for i in need])
    held = F.filter(positions, lambda i: (F.col("cnt_before") <= i) & (i < F.col("cnt_before") + F.col("cnt")))
    hits = ranked.where("o.inside").select("o.v", held.alias("at")).where(F.size("at") > 0)
    return {i: r["v"] for r in hits.collect() for i in r["at"]}  # two per probability


def approx_quantiles(df: DataFrame, col: str, probs: Sequence[float], accuracy: int = 10000) -> DataFrame:
    """``percentile_approx`` thresholds for very large inputs (A19 at scale)."""
    return df.select(
        F.posexplode(F.percentile_approx(F.col(col).cast("double"), list(probs), accuracy)).alias("i", "threshold")
    ).select(F.element_at(F.array(*[F.lit(float(p)) for p in probs]), F.col("i") + 1).alias("prob"), "threshold")
