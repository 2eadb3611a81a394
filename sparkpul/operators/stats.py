"""Statistical comparison of methods over datasets.

Everything is DataFrame aggregates, windows and joins over the method table: ranks, rank
sums, statistics, p-values, the pairs of methods and the step-down adjustments. The
distribution tails come from power series written as built-in expressions
(``normal_tail``, ``chi2_tail``). ``chi2_sf``, ``normal_two_sided`` and ``holm`` state the
same for single Python values.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize

# Terms of the error function's series; at |z| = 8 the rest is under 1e-16.
ERF_TERMS = 160


# ----------------------------------------------------------------------------- tails

def chi2_sf(x: float, dof: int) -> float:
    """Survival function of the chi-square distribution with integer ``dof``."""
    if x is None or dof is None or (isinstance(x, float) and math.isnan(x)):
        return float("nan")
    if x <= 0:
        return 1.0
    h = x / 2.0
    if dof % 2 == 0:
        term, total = 1.0, 1.0
        for i in range(1, dof // 2):
            term *= h / i
            total += term
        return math.exp(-h) * total
    total = math.erfc(math.sqrt(h))
    term = math.sqrt(h) / math.gamma(1.5)  # i = 1: h^(1/2) / Gamma(3/2)
    s = 0.0
    for i in range(1, (dof - 1) // 2 + 1):
        if i > 1:
            term *= h / (i - 0.5)
        s += term
    return total + math.exp(-h) * s


def normal_two_sided(z: float) -> float:
    """Two-sided normal p-value ``erfc(|z| / sqrt 2)``."""
    if z is None or (isinstance(z, float) and math.isnan(z)):
        return float("nan")
    return math.erfc(abs(z) / math.sqrt(2.0))


def erf(x: Column) -> Column:
    """``erf(x)`` for ``x >= 0`` by ``2/sqrt(pi) e^(-x^2) sum 2^n x^(2n+1) / (2n+1)!!``, whose
    terms are all positive (no cancellation)."""
    start = F.struct(x.alias("term"), x.alias("total"))
    step = F.aggregate(
        F.sequence(F.lit(1), F.lit(ERF_TERMS)),
        start,
        lambda a, n: F.struct(
            (a["term"] * 2 * x * x / (2 * n + 1)).alias("term"),
            (a["total"] + a["term"] * 2 * x * x / (2 * n + 1)).alias("total"),
        ),
        lambda a: a["total"],
    )
    return F.when(x > 6, F.lit(1.0)).otherwise(F.lit(2 / math.sqrt(math.pi)) * F.exp(-x * x) * step)


def normal_tail(z: Column) -> Column:
    """Two-sided normal p-value of ``z``."""
    return F.lit(1.0) - erf(F.abs(z) / F.lit(math.sqrt(2.0)))


def chi2_tail(x: Column, dof: Column) -> Column:
    """Survival function of the chi-square distribution with integer ``dof``: a finite sum
    of ``h^i / Gamma(i + 1)`` over i = 0, 1, .. or 1/2, 3/2, .. below ``dof / 2``."""
    h = x / 2
    odd = dof % 2 == 1
    shift = F.when(odd, F.lit(0.5)).otherwise(F.lit(0.0))
    count = F.floor(dof / 2).cast("int")
    first = F.when(odd, F.sqrt(h) / F.lit(math.gamma(1.5))).otherwise(F.lit(1.0))
    series = F.aggregate(
        F.sequence(F.lit(0), F.greatest(count, F.lit(1)) - 1),
        F.struct(first.alias("term"), F.lit(0.0).alias("total")),
        lambda a, i: F.struct((a["term"] * h / (i + 1 + shift)).alias("term"), (a["total"] + a["term"]).alias("total")),
        lambda a: a["total"],
    )
    tail = F.when(odd, F.lit(1.0) - erf(F.sqrt(h))).otherwise(F.lit(0.0))
    return F.when(x <= 0, F.lit(1.0)).otherwise(tail + F.when(count > 0, F.exp(-h) * series).otherwise(F.lit(0.0)))


# ----------------------------------------------------------------------------- ranks

def mean_tie_ranks(df: DataFrame, method: str, dataset: str, score: str, maximize: bool = True) -> DataFrame:
    """Rank of each method inside each dataset, ties get the mean rank."""
    order = F.col(score).desc() if maximize else F.col(score).asc()
    w = Window.partitionBy(dataset).orderBy(order)
    ties = Window.partitionBy(dataset, score)
    return df.withColumn(
        "rank", F.rank().over(w) + (F.count(F.lit(1)).over(ties) - 1) / 2.0
    )


def mean_ranks(df: DataFrame, method: str, dataset: str, score: str, maximize: bool = True) -> DataFrame:
    """Mean rank per method over datasets; lower is better."""
    r = mean_tie_ranks(df, method, dataset, score, maximize)
    return r.groupBy(method).agg(F.avg("rank").alias("mean_rank"), F.count(F.lit(1)).alias("n_datasets"))


def complete_blocks(df: DataFrame, method: str, dataset: str, score: str) -> None:
    """Raise unless every dataset holds every method exactly once, with a score (the tests
    compare complete blocks; anything else gives wrong ranks). One aggregate job."""
    cells = df.groupBy(method, dataset).agg(F.count(F.lit(1)).alias("n"), F.count(score).alias("scored"))
    seen = cells.agg(
        F.count(F.lit(1)).alias("cells"), F.countDistinct(method).alias("methods"),
        F.countDistinct(dataset).alias("datasets"), F.max("n").alias("most"), F.min("scored").alias("least"),
    ).first()
    if seen["cells"] and (seen["cells"] != seen["methods"] * seen["datasets"] or seen["most"] != 1 or seen["least"] != 1):
        raise ValueError(
            f"incomplete blocks: {seen['methods']} methods x {seen['datasets']} datasets need one score each, "
            f"found {seen['cells']} cells, up to {seen['most']} rows and at least {seen['least']} scores in a cell"
        )


def friedman(df: DataFrame, method: str, dataset: str, score: str, maximize: bool = True) -> DataFrame:
    """Friedman test (A25): ``12 N / (k (k+1)) * (sum R_j^2 - k (k+1)^2 / 4)``.

    One row: ``chi2, dof, pvalue, n_datasets, n_methods``. Datasets must hold every
    method once (complete block design), which is checked.
    """
    complete_blocks(df, method, dataset, score)
    mr = mean_ranks(df, method, dataset, score, maximize)
    agg = mr.agg(
        F.sum(F.col("mean_rank") * F.col("mean_rank")).alias("_s2"),
        F.count(F.lit(1)).alias("n_methods"),
        F.max("n_datasets").alias("n_datasets"),
    )
    k = F.col("n_methods").cast("double")
    n = F.col("n_datasets").cast("double")
    chi2 = F.lit(12.0) * n / (k * (k + 1)) * (F.col("_s2") - k * (k + 1) * (k + 1) / 4.0)
    return agg.select(
        chi2.alias("chi2"),
        (F.col("n_methods") - 1).cast("long").alias("dof"),
        "n_datasets",
        "n_methods",
    ).withColumn("pvalue", chi2_tail(F.col("chi2"), F.col("dof")))


def holm(pvalues: list[float]) -> list[float]:
    """Holm step-down adjustment ``max_{j <= i} min(1, (m - j + 1) p_(j))``, input order kept."""
    m = len(pvalues)
    order = sorted(range(m), key=lambda i: (pvalues[i], i))
    out, run = [0.0] * m, 0.0
    for j, i in enumerate(order):
        run = max(run, min(1.0, (m - j) * pvalues[i]))
        out[i] = run
    return out


def _ranked_methods(df: DataFrame, method: str, dataset: str, score: str, maximize: bool) -> DataFrame:
    """``method, r, k, n``: mean rank, number of methods and of datasets, computed once."""
    complete_blocks(df, method, dataset, score)
    ranks = materialize(mean_ranks(df, method, dataset, score, maximize), "mean-ranks")
    # one row per compared method: a window over all of them is as small
    whole = Window.partitionBy(F.lit(1))
    return ranks.select(
        method, F.col("mean_rank").alias("r"), F.count(F.lit(1)).over(whole).alias("k"),
        F.max("n_datasets").over(whole).alias("n"),
    )


def _standard_error() -> Column:
    return F.sqrt(F.col("k") * (F.col("k") + 1) / (F.lit(6.0) * F.col("n")))


def step_down(tests: DataFrame, p: str, order: list[str], out: str, factor: Column | None = None) -> DataFrame:
    """Step-down adjustment ``max_{j <= i} min(1, f_j p_(j))`` over all rows.

    ``factor`` gives ``f_j`` from the 1-based position ``_j`` and the number of rows
    ``_m``; Holm's ``m - j + 1`` by default. Equal p-values are ordered by ``order``.
    """
    w = Window.partitionBy(F.lit(1)).orderBy(p, *order)
    numbered = tests.withColumn("_j", F.row_number().over(w)).withColumn("_m", F.count(F.lit(1)).over(Window.partitionBy(F.lit(1))))
    factor = (F.col("_m") - F.col("_j") + 1) if factor is None else factor
    scaled = numbered.withColumn("_s", F.least(F.lit(1.0), factor * F.col(p)))
    running = w.rowsBetween(Window.unboundedPreceding, 0)
    return scaled.withColumn(out, F.max("_s").over(running)).drop("_j", "_m", "_s")


def shaffer_counts(k: int) -> list[int]:
    """The possible numbers of true hypotheses among all pairs of ``k`` means, ascending.

    Equal means form groups; a group of size g holds ``g (g - 1) / 2`` true pairs.
    """
    possible: list[set[int]] = [{0}]
    for size in range(1, k + 1):
        possible.append({g * (g - 1) // 2 + rest for g in range(1, size + 1) for rest in possible[size - g]})
    return sorted(possible[k])


def control_posthoc(
    df: DataFrame, method: str, dataset: str, score: str, maximize: bool = True, with_p: bool = True
) -> DataFrame:
    """Control post-hoc (A26): every method against the best mean rank.

    ``z = (R_i - R_control) / sqrt(k (k+1) / (6 N))``; two-sided normal p, Holm
    adjusted over the ``k - 1`` comparisons; win / tie / loss of the control against
    each method over the datasets (an equi-join on the dataset).
    """
    ranks = _ranked_methods(df, method, dataset, score, maximize)
    best = Window.partitionBy(F.lit(1)).orderBy("r", method)
    comp = ranks.select(
        method, "r", "k", "n", F.first(method).over(best).alias("control"), F.first("r").over(best).alias("rc")
    ).where(F.col(method) != F.col("control"))
    comp = comp.withColumn("z", (F.col("r") - F.col("rc")) / _standard_error())
    comp = step_down(comp.withColumn("pvalue", normal_tail(F.col("z"))), "pvalue", [method], "p_holm")
    control = ranks.orderBy("r", method).limit(1).select(F.col(method).alias("_c"))
    cs = df.join(control, F.col(method) == F.col("_c")).select(dataset, F.col(score).alias("_cs"), "_c")
    ms = df.select(method, dataset, F.col(score).alias("_ms"))
    better = (F.col("_cs") > F.col("_ms")) if maximize else (F.col("_cs") < F.col("_ms"))
    worse = (F.col("_cs") < F.col("_ms")) if maximize else (F.col("_cs") > F.col("_ms"))
    wtl = ms.join(cs, dataset).where(F.col(method) != F.col("_c")).groupBy(method).agg(
        F.sum(better.cast("long")).alias("win"),
        F.sum((F.col("_cs") == F.col("_ms")).cast("long")).alias("tie"),
        F.sum(worse.cast("long")).alias("loss"),
    )
    out = comp.withColumnRenamed("r", "mean_rank").join(wtl, method, "left")
    cols = [method, "control", "mean_rank", "z", "win", "tie", "loss"] + (["pvalue", "p_holm"] if with_p else [])
    return out.select(*cols)


#: most methods the exhaustive sets are searched for
MAX_EXHAUSTIVE = 16


def most_true_pairs(k: int, false_pairs: set[tuple[int, int]]) -> int:
    """The most pairs of ``k`` means that can be equal at once when ``false_pairs`` differ.

    Equal means form groups without a false pair inside. The search runs over partitions of
    the means: the first mean left is put with every set of others it may be equal to,
    largest first, and a branch is left when even one group of all the rest gains nothing.
    """
    enemies = [0] * k
    for a, b in false_pairs:
        enemies[a] |= 1 << b
        enemies[b] |= 1 << a
    seen: dict[int, int] = {}

    def best(left: int) -> int:
        if left in seen:
            return seen[left]
        if not left:
            return 0
        first = left & -left
        others = left & ~first & ~enemies[first.bit_length() - 1]
        top, group = -1, others
        while True:
            size = group.bit_count() + 1
            rest = left.bit_count() - size
            if size * (size - 1) // 2 + rest * (rest - 1) // 2 > top and _friendly(group, enemies):
                top = max(top, size * (size - 1) // 2 + best(left & ~first & ~group))
            if not group:
                break
            group = (group - 1) & others
        seen[left] = top
        return top

    return best((1 << k) - 1)


def _friendly(group: int, enemies: list[int]) -> bool:
    left = group
    while left:
        i = left.bit_length() - 1
        if enemies[i] & group:
            return False
        left &= ~(1 << i)
    return True


def _dynamic_factors(pairs: DataFrame, names: list[str]) -> DataFrame:
    """``names, _true``: for each pair, in the order of p-values, the most pairs that can be
    true when all pairs before it are false. One small group: a row per pair of methods."""

    def factors(table):
        table = table.sort_values(["pvalue", *names])
        methods = {m: i for i, m in enumerate(sorted(set(table[names[0]]) | set(table[names[1]])))}
        if len(methods) > MAX_EXHAUSTIVE:
            raise ValueError(f"exhaustive sets of {len(methods)} methods, at most {MAX_EXHAUSTIVE} are searched")
        rejected, out = set(), []
        for a, b in zip(table[names[0]], table[names[1]], strict=True):
            out.append(max(1, most_true_pairs(len(methods), rejected)))
            rejected.add((methods[a], methods[b]))
        return table[names].assign(_true=out)

    kinds = ", ".join(f"{n} {pairs.schema[n].dataType.simpleString()}" for n in names)
    return pairs.select(*names, "pvalue", F.lit(0).alias("_one")).groupBy("_one").applyInPandas(factors, f"{kinds}, _true int")


def pairwise_posthoc(
    df: DataFrame, method: str, dataset: str, score: str, maximize: bool = True, with_p: bool = True,
    adjust: str = "shaffer",
) -> DataFrame:
    """All method pairs ``a < b`` (A27): z of the mean-rank difference, two-sided p, and its
    Holm and Shaffer adjustments over the ``k (k-1) / 2`` pairs.

    Pairs are of methods, not rows: a self-join of the method table on ``a < b``. Shaffer's
    static factor at step j is the largest possible number of true hypotheses that is at
    most ``m - j + 1`` (``shaffer_counts``, at most ``k (k-1) / 2 + 1`` numbers).
    ``adjust='shaffer-dynamic'`` adds ``p_shaffer_dynamic``, whose factor is the largest
    number that can be true when the very pairs rejected before are false.
    """
    if adjust not in ("shaffer", "shaffer-dynamic"):
        raise ValueError(f"unknown adjustment {adjust}")
    ranks = _ranked_methods(df, method, dataset, score, maximize)
    a = ranks.select(F.col(method).alias("method_a"), F.col("r").alias("rank_a"), "k", "n")
    b = ranks.select(F.col(method).alias("method_b"), F.col("r").alias("rank_b"))
    pairs = a.join(b, F.col("method_a") < F.col("method_b"))
    pairs = pairs.withColumn("z", (F.col("rank_a") - F.col("rank_b")) / _standard_error())
    cols = ["method_a", "method_b", "rank_a", "rank_b", "z"]
    if not with_p:
        return pairs.select(*cols)
    pairs = pairs.withColumn("pvalue", normal_tail(F.col("z")))
    counts = shaffer_counts(ranks.count())
    left = F.col("_m") - F.col("_j") + 1
    true_left = F.array_max(F.filter(F.array(*[F.lit(c) for c in counts]), lambda c: c <= left))
    names = ["method_a", "method_b"]
    adjusted = step_down(pairs, "pvalue", names, "p_holm")
    adjusted = step_down(adjusted, "pvalue", names, "p_shaffer", F.greatest(true_left, F.lit(1)))
    out = [*cols, "pvalue", "p_holm", "p_shaffer"]
    if adjust == "shaffer-dynamic":
        factors = _dynamic_factors(pairs, names)
        adjusted = step_down(adjusted.join(factors, names), "pvalue", names, "p_shaffer_dynamic", F.col("_true"))
        out.append("p_shaffer_dynamic")
    return adjusted.select(*out)


def mark_best(df: DataFrame, method: str, dataset: str, score: str, maximize: bool = True) -> DataFrame:
    """Flag the best value of each dataset."""
    w = Window.partitionBy(dataset)
    best = F.max(score).over(w) if maximize else F.min(score).over(w)
    return df.withColumn("is_best", F.col(score) == best)
