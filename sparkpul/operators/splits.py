"""Exact, reproducible splits and draws.

A draw of ``floor(frac * n)`` rows without replacement is the first rows by the md5
key ``md5('seed:id')`` inside each class (``ranking.hash_rank``). The same key order
in DuckDB gives the same rows, so every split is oracle-checkable. Successive draws
from one class (validation, then rows hidden in U) take consecutive rank ranges of
one ordering, which is again a uniform draw from what is left.
"""

from __future__ import annotations

import math
from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import greater, label, md5_key
from ..session import checkpoint
from .ranking import _join, hash_rank

DEFAULT_SEED = 1234


def class_counts(df: DataFrame, by: str) -> dict:
    """Rows per class value; one small aggregate row per class."""
    return {r[by]: r["n"] for r in df.groupBy(by).agg(F.count(F.lit(1)).alias("n")).collect()}


def _with_amounts(ranked: DataFrame, df: DataFrame, by: str, frac: float, out: str) -> DataFrame:
    """Attach ``floor(frac * n)`` of each row's class: one aggregate row per class of
    ``df``, joined null-safely (a null class is a class), whatever their number."""
    sizes = df.groupBy(by).agg(F.floor(F.count(F.lit(1)) * F.lit(float(frac))).cast("long").alias(out))
    return _join(ranked, sizes, [by])


def _rank_by_hash(df: DataFrame, id_col: str, by, seed: int, salt: str | None = None) -> DataFrame:
    key_cols = [salt, id_col] if salt else [id_col]
    keyed = df.withColumn("_hk", md5_key(seed, *[F.lit(c) if c == salt else F.col(c) for c in key_cols]))
    n = keyed.count()
    return hash_rank(keyed, "_hk", id_col, by=by, rank_col="_hrank", n_rows=n).drop("_hk")


def exact_sample(
    df: DataFrame,
    id_col: str,
    frac: float | None = None,
    n: int | None = None,
    by: str | None = None,
    seed: int = DEFAULT_SEED,
    flag: str = "sampled",
) -> DataFrame:
    """Flag exactly ``floor(frac * n_class)`` (or ``n``) rows per class, drawn by md5.

    Without ``by`` the whole table is one class.
    """
    if (frac is None) == (n is None):
        raise ValueError("give exactly one of frac or n")
    keyed = df.withColumn("_hk", md5_key(seed, id_col))
    if by:
        largest = df.groupBy(by).count().agg(F.max("count")).first()[0]
        ranked = hash_rank(keyed, "_hk", id_col, by=[by], rank_col="_hrank", n_rows=int(largest or 1))
        if n is not None:
            amount = F.lit(int(n))
        else:
            ranked = _with_amounts(ranked, df, by, frac, "_amt")
            amount = F.col("_amt")
        return ranked.withColumn(flag, F.col("_hrank") <= amount).drop("_hrank", "_hk", "_amt")
    else:
        total = df.count()
        ranked = hash_rank(keyed, "_hk", id_col, rank_col="_hrank", n_rows=total)
        amount = F.lit(int(n) if n is not None else int(math.floor(total * frac)))
    return ranked.withColumn(flag, F.col("_hrank") <= amount).drop("_hrank", "_hk")


def permutation(df: DataFrame, id_col: str, seed: int = DEFAULT_SEED, pos_col: str = "pos") -> DataFrame:
    """Random permutation as an explicit 1-based position column."""
    return _rank_by_hash(df, id_col, [], seed).withColumnRenamed("_hrank", pos_col)


def pn_test_split(
    df: DataFrame,
    id_col: str,
    reliable: Column,
    positive: Column,
    test_frac: float,
    seed: int = DEFAULT_SEED,
) -> DataFrame:
    """PN test split.

    ``floor(test_frac * n)`` rows of each true class (``positive``) become ``test``;
    the rest is ``train``. ``y_true`` is the true class, ``y_pu`` the reliable-positive
    flag (on test rows it is the reference's ``y_test_pu``). Null or NaN scores fall
    on the negative side (N1, N2): build the predicates with ``functions.greater``.
    """
    labelled = df.withColumn("y_true", label(positive)).withColumn("y_pu", label(reliable))
    counts = class_counts(labelled, "y_true")
    keyed = labelled.withColumn("_hk", md5_key(seed, id_col))
    ranked = hash_rank(keyed, "_hk", id_col, by=["y_true"], rank_col="_hrank", n_rows=max(counts.values(), default=1))
    return (
        _with_amounts(ranked, labelled, "y_true", test_frac, "_amt")
        .withColumn("split", F.when(F.col("_hrank") <= F.col("_amt"), "test").otherwise("train"))
        .drop("_hrank", "_amt", "_hk")
    )


@dataclass(frozen=True)
class SplitPlan:
    """Row counts that ``build_pu`` draws (A20). ``positives`` and ``unlabeled`` are what it
    has, the ``val_`` and ``hidden`` fields what it takes from each; the rest follows."""

    positives: int
    unlabeled: int
    requested: int
    val_rows: int
    val_positives: int
    hidden_positives: int
    known_positives: int

    @property
    def val_unlabeled(self) -> int:
        return self.val_rows - self.val_positives

    @property
    def train_rows(self) -> int:
        return self.positives + self.unlabeled - self.val_rows

    @property
    def train_unlabeled(self) -> int:
        return self.unlabeled - self.val_unlabeled + self.hidden_positives

    def as_dict(self) -> dict:
        return asdict(self) | {
            k: getattr(self, k) for k in ("val_unlabeled", "train_rows", "train_unlabeled")
        }


def plan_sizes(
    n_pos: int, n_unl: int, frac: float, val_split: float, val_share, move_frac: float
) -> SplitPlan:
    """Sizes of the draws: ``floor(val_split * floor(frac * n))`` validation rows, of which a
    share is positive (``"same"``: the table's own share), then of the positives left
    ``floor(move_frac * rest)`` hidden and ``floor((1 - move_frac) * rest)`` known."""
    n = n_pos + n_unl
    requested = math.floor(n * frac)
    val_rows = math.floor(requested * val_split)
    share = (n_pos / n if n else 0.0) if val_share == "same" else float(val_share)
    val_pos = math.floor(val_rows * share)
    for kind, want, have in (("positive", val_pos, n_pos), ("unlabeled", val_rows - val_pos, n_unl)):
        if val_share != "same" and want > have:
            raise ValueError(f"validation needs {want} {kind} rows (share {share}), the table has {have}")
    rest = n_pos - val_pos
    return SplitPlan(
        positives=n_pos, unlabeled=n_unl, requested=requested, val_rows=val_rows, val_positives=val_pos,
        hidden_positives=math.floor(rest * move_frac), known_positives=math.floor(rest * (1.0 - move_frac)),
    )


def build_pu(
    df: DataFrame,
    id_col: str,
    reliable: Column,
    positive: Column,
    test_frac: float,
    val_split: float,
    val_share="same",
    move_frac: float = 0.0,
    frac: float = 1.0,
    seed: int = DEFAULT_SEED,
    return_plan: bool = False,
):
    """PU builder (D2): PN test split, then validation rows, then positives hidden in U.

    Output columns: ``split`` (train/val/test), ``y_pu`` (train: 1 known positive, 0
    unlabeled or moved; val: 1/0 by the same rule; test: reliable flag), ``y_true``,
    ``moved`` (a known positive relabelled 0). ``frac`` shrinks only the validation
    size, as in the reference.
    """
    # read three times below (class counts, train ranks, test rows): materialized once
    base = checkpoint(pn_test_split(df, id_col, reliable, positive, test_frac, seed))
    train = base.where(F.col("split") == "train")
    counts = class_counts(train, "y_pu")
    plan = plan_sizes(counts.get(1, 0), counts.get(0, 0), frac, val_split, val_share, move_frac)
    keyed = train.withColumn("_hk", md5_key(seed, F.lit("val"), id_col))
    ranked = hash_rank(keyed, "_hk", id_col, by=["y_pu"], rank_col="_hrank",
                       n_rows=max(counts.values(), default=1)).drop("_hk")
    vp, vu, mv = plan.val_positives, plan.val_unlabeled, plan.hidden_positives
    is_pos = F.col("y_pu") == 1
    r = F.col("_hrank")
    in_val = F.when(is_pos, r <= vp).otherwise(r <= vu)
    moved = is_pos & (r > vp) & (r <= vp + mv)
    train_out = (
        ranked.withColumn("split", F.when(in_val, "val").otherwise("train"))
        .withColumn("moved", moved)
        .withColumn("y_pu", F.when(moved, F.lit(0)).otherwise(F.col("y_pu")))
        .drop("_hrank")
    )
    test_out = base.where(F.col("split") == "test").withColumn("moved", F.lit(False))
    out = train_out.unionByName(test_out)
    return (out, plan) if return_plan else out


def split_plan_frame(spark, plan: SplitPlan) -> DataFrame:
    """The plan as a one-row table."""
    d = plan.as_dict()
    return spark.createDataFrame([tuple(int(v) for v in d.values())], schema=", ".join(f"{k} long" for k in d))


def stratified_split(
    df: DataFrame, id_col: str, label_col: str, val_frac: float, seed: int = DEFAULT_SEED
) -> DataFrame:
    """Train/val split stratified by ``label_col`` (D3): ``floor(val_frac * n_class)`` per class
    go to ``val``. sklearn's ``train_test_split`` rounds the class sizes differently."""
    s = exact_sample(df, id_col, frac=val_frac, by=label_col, seed=seed, flag="_v")
    return s.withColumn("split", F.when(F.col("_v"), "val").otherwise("train")).drop("_v")


def bernoulli_tags(
    df: DataFrame, id_col: str, p_col: str, m: int, seed: int = DEFAULT_SEED
) -> DataFrame:
    """``m`` tagged copies: copy ``j`` labels a row 1 when ``u(seed, id, j) < p``.

    The uniform comes from md5, so it is identical in Spark and DuckDB.
    """
    from ..functions.columns import md5_uniform

    return df.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(m - 1)))).withColumn(
        "tag", (md5_uniform(seed, id_col, "copy") < F.col(p_col)).cast("int")
    )


def bernoulli_tag_array(id_col: str, p_col: str, m: int, seed: int = DEFAULT_SEED) -> Column:
    """The tags of ``bernoulli_tags`` for all ``m`` copies as one array of a row."""
    from ..functions.columns import md5_uniform

    return F.transform(
        F.sequence(F.lit(0), F.lit(m - 1)), lambda j: (md5_uniform(seed, id_col, j) < F.col(p_col)).cast("int")
    )


def cross_source_pu(
    p_df: DataFrame, u_df: DataFrame, id_col: str, val_frac: float, seed: int = DEFAULT_SEED
) -> DataFrame:
    """All of source A is positive, all of source B unlabeled (its own labels dropped),
    then a stratified train/val split (D10)."""
    p = p_df.select(id_col, *[c for c in p_df.columns if c != id_col]).withColumn("y_pu", F.lit(1))
    u = u_df.withColumn("y_pu", F.lit(0))
    both = p.unionByName(u, allowMissingColumns=True)
    return stratified_split(both, id_col, "y_pu", val_frac, seed)


def whole_as_test(df: DataFrame, id_col: str, reliable: Column, positive: Column) -> DataFrame:
    """The whole table as a PN test set (D9): ``pn_test_split`` with ``test_frac = 1``."""
    return pn_test_split(df, id_col, reliable, positive, 1.0)


def presplit_recipe(
    train: DataFrame,
    val: DataFrame,
    test: DataFrame,
    id_col: str,
    reliable: Column,
    positive: Column,
) -> DataFrame:
    """Dataset recipe for tables that come split already (D8): train rows keep the
    reliable label, val rows likewise, test rows are a PN test set."""
    tr = train.withColumn("y_true", label(positive)).withColumn("y_pu", label(reliable)).withColumn("split", F.lit("train"))
    va = val.withColumn("y_true", label(positive)).withColumn("y_pu", label(reliable)).withColumn("split", F.lit("val"))
    te = whole_as_test(test, id_col, reliable, positive)
    return tr.unionByName(va).unionByName(te)


def single_table_recipe(
    df: DataFrame,
    id_col: str,
    score: str,
    reliable_above: float,
    positive_from: float,
    val_split: float = 0.2,
    test_frac: float = 0.2,
    move_frac: float = 0.0,
    seed: int = DEFAULT_SEED,
) -> DataFrame:
    """Dataset recipe for one scored table (D7): known positive ``score > reliable_above``,
    true positive ``score >= positive_from``, 20 % test, 20 % validation with the train
    positive share, nothing hidden, seed 1234 (the experiments' settings)."""
    return build_pu(
        df, id_col, greater(score, reliable_above), greater(score, positive_from, inclusive=True),
        test_frac=test_frac, val_split=val_split, val_share="same", move_frac=move_frac, seed=seed,
    )
