"""Registered queries for result tables, statistics and column helpers.

The result table is derived from ``orders``: method = order priority, dataset =
order year, metric = mean total price (see ``tables.result_table``).
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import metrics as M
from ..operators import results as R
from ..operators import stats as ST
from ..session import materialize
from .queries import register, r6, sql_round_even
from .tables import result_table, table

# The benchmark's order priorities and the years present at sf0.01.
PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
YEARS = ["1995", "1996", "1997", "1998", "1999", "2000", "2001"]
STATUS_NAMES = {"F": "finished", "O": "open", "P": "partial"}
DISCOUNTS = [0.0, 0.01, 0.02, 0.03, 0.04, 0.05, 0.06, 0.07, 0.08, 0.09, 0.1]

RES = """res AS (SELECT o_orderpriority AS method, CAST(year(o_orderdate) AS VARCHAR) AS dataset,
                 avg(o_totalprice) AS metric FROM orders GROUP BY 1, 2)"""


def _esc(s: str) -> str:
    return s.replace("'", "''")


def _pivot_sql(index: str, key: str, names: list[str], src: str, value: str = "metric") -> str:
    cols = ",\n       ".join(
        f"round(max(CASE WHEN {key} = '{_esc(n)}' THEN {value} END), 6) AS \"{n}\"" for n in names
    )
    return f"SELECT {index},\n       {cols}\nFROM {src} GROUP BY {index}"


@register("pivot_one_axis", f"WITH {RES}\n" + _pivot_sql("method", "dataset", YEARS, "res"))
def q_pivot_one_axis(spark, sf_dir):
    """Method x dataset pivot of the result table (pandas-style duplicate check)."""
    res = result_table(spark, sf_dir)
    wide = R.pivot_results(res, "method", "dataset", "metric")
    return wide.select("method", *[r6(F.col(f"`{c}`")).alias(c) for c in wide.columns if c != "method"])


FLAT_NAMES = [f"({y}, '{p}')" for y in YEARS for p in PRIORITIES]


@register(
    "pivot_flat_names",
    """WITH r AS (SELECT o_orderstatus AS status, '(' || year(o_orderdate) || ', ''' || o_orderpriority || ''')' AS k,
                avg(o_totalprice) AS metric FROM orders GROUP BY 1, 2)\n"""
    + _pivot_sql("status", "k", FLAT_NAMES, "r"),
)
def q_pivot_flat_names(spark, sf_dir):
    """Status x (year, priority) pivot with flattened tuple names."""
    o = table(spark, sf_dir, "orders")
    res = o.groupBy(
        F.col("o_orderstatus").alias("status"),
        F.year("o_orderdate").alias("year"),
        F.col("o_orderpriority").alias("priority"),
    ).agg(F.avg("o_totalprice").alias("metric"))
    wide = R.pivot_results(res, "status", ["year", "priority"], "metric")
    return wide.select("status", *[r6(F.col(f"`{c}`")).alias(c) for c in wide.columns if c != "status"])


@register(
    "matrix_pivot",
    """WITH r AS (SELECT l_tax, CAST(l_discount AS VARCHAR) AS k, avg(l_extendedprice) AS metric
           FROM lineitem GROUP BY 1, 2)\n"""
    + _pivot_sql("l_tax", "k", [str(d) for d in DISCOUNTS], "r"),
)
def q_matrix_pivot(spark, sf_dir):
    """Numeric matrix pivot (tax x discount, mean price), like quantile x prior."""
    li = table(spark, sf_dir, "lineitem")
    res = li.groupBy("l_tax", "l_discount").agg(F.avg("l_extendedprice").alias("metric"))
    wide = R.pivot_results(res, "l_tax", "l_discount", "metric")
    return wide.select("l_tax", *[r6(F.col(f"`{c}`")).alias(c) for c in wide.columns if c != "l_tax"])


@register(
    "widen_by_setting",
    f"WITH {RES}\nSELECT method, "
    + ", ".join(
        f"round(max(CASE WHEN dataset = '{y}' THEN metric END), 6) AS metric_{y}, "
        f"max(CASE WHEN dataset = '{y}' THEN n END)::BIGINT AS n_{y}"
        for y in YEARS
    )
    + "\nFROM (SELECT r.*, c.n FROM res r JOIN (SELECT o_orderpriority AS method, CAST(year(o_orderdate) AS VARCHAR) AS dataset,"
    " count(*) AS n FROM orders GROUP BY 1, 2) c USING (method, dataset)) GROUP BY method",
)
def q_widen_by_setting(spark, sf_dir):
    """J7 + P6 + P7 + P8 + U3: one metric column per setting, joined on the method."""
    o = table(spark, sf_dir, "orders")
    res = o.groupBy(
        F.col("o_orderpriority").alias("method"), F.year("o_orderdate").cast("string").alias("dataset")
    ).agg(F.avg("o_totalprice").alias("metric"), F.count(F.lit(1)).alias("n"))
    # the aggregate of a few rows is read once per setting: computed once
    res = materialize(res, "by-setting")
    settings = res.select("dataset").distinct().orderBy("dataset").limit(R.MAX_PIVOT_COLUMNS).collect()
    frames = {r["dataset"]: res.where(F.col("dataset") == r["dataset"]) for r in settings}
    wide = R.widen_by_setting(frames, "method", ["metric", "n"], drop=["dataset"])
    metric_cols = R.select_prefix(wide, "metric_", keep=["method"]).columns
    n_cols = [c for c in wide.columns if c.startswith("n_")]
    return wide.select(*[r6(c).alias(c) if c.startswith("metric_") else F.col(c) for c in metric_cols],
                       *[F.col(c).cast("long") for c in n_cols])


FALL_RES = """r AS (SELECT o_orderpriority AS classifier, 'S+' || o_orderstatus || '-' || year(o_orderdate) AS setting,
              avg(o_totalprice) AS metric FROM orders GROUP BY 1, 2)"""


@register(
    "metric_fall",
    f"""WITH {FALL_RES}
SELECT t.train AS train_ds, d.classifier, {sql_round_even("(1 - d.metric / s.metric) * 100", 2)} AS fall
FROM (VALUES ('F'), ('O'), ('P')) t(train), (VALUES ('1996'), ('1997'), ('1998'), ('1999'), ('2000'), ('2001')) y(test)
JOIN r d ON d.setting = 'S+' || t.train || '-' || y.test
JOIN r s ON s.setting = 'S+' || t.train || '-1995' AND s.classifier = d.classifier""",
)
def q_metric_fall(spark, sf_dir):
    """J9 + A18 + F8 + F9: relative fall of the metric, other test year vs same."""
    o = table(spark, sf_dir, "orders")
    res = o.groupBy(
        F.col("o_orderpriority").alias("classifier"),
        C.format_setting("S+{}-{}", F.col("o_orderstatus"), F.year("o_orderdate")).alias("setting"),
    ).agg(F.avg("o_totalprice").alias("metric"))
    pairs = [((s, y), (s, YEARS[0])) for s in STATUS_NAMES for y in YEARS[1:]]
    return R.metric_fall(materialize(res, "by-setting"), "classifier", "setting", "metric", pairs, "S+{}-{}")


@register(
    "with_baseline",
    f"""WITH {RES},
b AS (SELECT o_orderpriority AS method, CAST(year(o_orderdate) AS VARCHAR) AS dataset, avg(o_totalprice) AS metric
      FROM orders WHERE o_orderstatus = 'F' GROUP BY 1, 2)
SELECT r.method, r.dataset, round(r.metric, 6) AS metric, round(b.metric, 6) AS baseline
FROM res r LEFT JOIN b ON r.method = b.method AND r.dataset = b.dataset""",
)
def q_with_baseline(spark, sf_dir):
    """Attach the baseline (finished orders only) of the same method and dataset."""
    res = result_table(spark, sf_dir)
    o = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'")
    base = o.groupBy(
        F.col("o_orderpriority").alias("method"), F.year("o_orderdate").cast("string").alias("dataset")
    ).agg(F.avg("o_totalprice").alias("metric"))
    out = R.with_baseline(res, base, ["method", "dataset"], "metric")
    return out.select("method", "dataset", r6("metric").alias("metric"), r6("baseline").alias("baseline"))


@register(
    "distinct_values",
    """SELECT DISTINCT o_orderpriority FROM orders""",
)
def q_distinct_values(spark, sf_dir):
    """A22 + U4: distinct method names."""
    return R.distinct_values(table(spark, sf_dir, "orders"), "o_orderpriority")


@register(
    "distinct_counts",
    """SELECT count(DISTINCT o_orderpriority)::BIGINT AS n_methods, count(DISTINCT year(o_orderdate))::BIGINT AS n_datasets
FROM orders""",
)
def q_distinct_counts(spark, sf_dir):
    """Number of distinct methods and datasets (``nunique``)."""
    o = table(spark, sf_dir, "orders")
    return o.agg(
        F.countDistinct("o_orderpriority").alias("n_methods"),
        F.countDistinct(F.year("o_orderdate")).alias("n_datasets"),
    )


@register(
    "metric_by_k",
    """WITH d AS (SELECT 'knn-' || (CAST(substr(o_orderpriority, 1, 1) AS INTEGER) * 4 + 1) AS detector,
                year(o_orderdate) AS seed, avg(o_totalprice) AS metric FROM orders GROUP BY 1, 2)
SELECT CAST(substr(detector, 5) AS INTEGER) AS k, round(avg(metric), 6) AS mean, round(stddev_samp(metric), 6) AS std,
       count(*)::BIGINT AS n FROM d GROUP BY 1""",
)
def q_metric_by_k(spark, sf_dir):
    """A23 + F6: metric per k over seeds; detector names ``knn-{k}`` parsed back to k."""
    o = table(spark, sf_dir, "orders")
    det = F.concat(F.lit("knn-"), (F.substring("o_orderpriority", 1, 1).cast("int") * 4 + 1).cast("string"))
    d = o.groupBy(det.alias("detector"), F.year("o_orderdate").alias("seed")).agg(F.avg("o_totalprice").alias("metric"))
    out = R.metric_by_k(d.withColumn("k", C.suffix_int("detector")), "k", "metric")
    return out.select("k", r6("mean").alias("mean"), r6("std").alias("std"), "n")


@register(
    "metric_band",
    f"""WITH d AS (SELECT CAST(substr(o_orderpriority, 1, 1) AS INTEGER) * 4 + 1 AS k, o_orderkey AS key, o_totalprice AS m FROM orders),
s AS (SELECT k, m, r.b, ('0x' || substr(md5('1234:' || key || ':' || r.b // 4), 1 + 8 * (r.b % 4), 8))::BIGINT::DOUBLE / 4294967296.0 AS u
      FROM d, unnest(range(100)) AS r(b)),
w AS (SELECT k, b, m, {" + ".join(f"(u >= {c!r})::INTEGER" for c in R.poisson_one_cdf())} AS w FROM s),
e AS (SELECT k, b, sum(w * m) / sum(w) AS mean FROM w WHERE w > 0 GROUP BY k, b)
SELECT k, round(quantile_cont(mean, 0.025), 3) AS low, round(quantile_cont(mean, 0.975), 3) AS high FROM e GROUP BY k""",
)
def q_metric_band(spark, sf_dir):
    """Bootstrap band of the mean metric per k, 100 replicates in one scan of all orders."""
    k = F.substring("o_orderpriority", 1, 1).cast("int") * 4 + 1
    d = table(spark, sf_dir, "orders").select(k.alias("k"), "o_orderkey", "o_totalprice")
    out = R.bootstrap_band(d, "k", "o_totalprice", ["o_orderkey"], 100)
    return out.select("k", F.round("low", 3).alias("low"), F.round("high", 3).alias("high"))


RANKS = f"""{RES},
rk AS (SELECT *, rank() OVER (PARTITION BY dataset ORDER BY metric DESC)
              + (count(*) OVER (PARTITION BY dataset, metric) - 1) / 2.0 AS rank FROM res)"""


@register(
    "mean_ranks",
    f"""WITH {RANKS}
SELECT method, round(avg(rank), 6) AS mean_rank, count(*)::BIGINT AS n_datasets FROM rk GROUP BY method""",
)
def q_mean_ranks(spark, sf_dir):
    """Mean-tie ranks of methods per dataset (larger metric is better), averaged."""
    res = result_table(spark, sf_dir)
    out = ST.mean_ranks(res, "method", "dataset", "metric")
    return out.select("method", r6("mean_rank").alias("mean_rank"), "n_datasets")


@register(
    "friedman",
    f"""WITH {RANKS},
mr AS (SELECT method, avg(rank) AS r, count(*) AS n FROM rk GROUP BY method),
a AS (SELECT sum(r * r) AS s2, count(*) AS k, max(n) AS n FROM mr),
c AS (SELECT 12.0 * n / (k * (k + 1)) * (s2 - k * (k + 1) * (k + 1) / 4.0) AS chi2, k, n FROM a)
SELECT round(chi2, 6) AS chi2, (k - 1)::BIGINT AS dof, n::BIGINT AS n_datasets, k::BIGINT AS n_methods,
       round(exp(-chi2 / 2) * (1 + chi2 / 2), 6) AS pvalue FROM c""",
)
def q_friedman(spark, sf_dir):
    """Friedman chi-square and p (5 methods: 4 degrees of freedom) over the years."""
    res = result_table(spark, sf_dir)
    out = ST.friedman(res, "method", "dataset", "metric")
    return out.select(r6("chi2").alias("chi2"), "dof", "n_datasets", "n_methods", r6("pvalue").alias("pvalue"))


@register(
    "control_posthoc_z",
    f"""WITH {RANKS},
mr AS (SELECT method, avg(rank) AS r, count(*) AS n FROM rk GROUP BY method),
ctl AS (SELECT method AS control, r AS rc FROM mr ORDER BY r, method LIMIT 1),
kn AS (SELECT count(*) AS k, max(n) AS n FROM mr),
wtl AS (SELECT m.method, sum((c.metric > m.metric)::INTEGER)::BIGINT AS win, sum((c.metric = m.metric)::INTEGER)::BIGINT AS tie,
               sum((c.metric < m.metric)::INTEGER)::BIGINT AS loss
        FROM res m JOIN res c ON m.dataset = c.dataset JOIN ctl ON c.method = ctl.control
        WHERE m.method <> ctl.control GROUP BY m.method)
SELECT mr.method, ctl.control, round(mr.r, 6) AS mean_rank, round((mr.r - ctl.rc) / sqrt(kn.k * (kn.k + 1) / (6.0 * kn.n)), 6) AS z,
       wtl.win, wtl.tie, wtl.loss
FROM mr, ctl, kn, wtl WHERE mr.method <> ctl.control AND wtl.method = mr.method""",
)
def q_control_posthoc_z(spark, sf_dir):
    """Control post-hoc statistics (z, win/tie/loss of the best-ranked method)."""
    res = result_table(spark, sf_dir)
    out = ST.control_posthoc(res, "method", "dataset", "metric", with_p=False)
    return out.select("method", "control", r6("mean_rank").alias("mean_rank"), r6("z").alias("z"), "win", "tie", "loss")


def _erf_sql(x: str) -> str:
    """erf of a non-negative value by its series of positive terms, as one list expression."""
    return (
        f"(2 / sqrt(pi()) * exp(-({x}) * ({x})) * list_sum(list_transform(range(0, 161), lambda i: "
        f"CASE WHEN ({x}) = 0 THEN 0 ELSE exp(2 * i * ln(2) + (2 * i + 1) * ln({x}) + lgamma(i + 1) - lgamma(2 * i + 2)) END)))"
    )


@register(
    "control_posthoc",
    f"""WITH {RANKS},
mr AS (SELECT method, avg(rank) AS r, count(*) AS n FROM rk GROUP BY method),
ctl AS (SELECT method AS control, r AS rc FROM mr ORDER BY r, method LIMIT 1),
kn AS (SELECT count(*) AS k, max(n) AS n FROM mr),
wtl AS (SELECT m.method, sum((c.metric > m.metric)::INTEGER)::BIGINT AS win, sum((c.metric = m.metric)::INTEGER)::BIGINT AS tie,
               sum((c.metric < m.metric)::INTEGER)::BIGINT AS loss
        FROM res m JOIN res c ON m.dataset = c.dataset JOIN ctl ON c.method = ctl.control
        WHERE m.method <> ctl.control GROUP BY m.method),
z AS (SELECT mr.method, control, r, (r - rc) / sqrt(k * (k + 1) / (6.0 * kn.n)) AS z FROM mr, ctl, kn WHERE mr.method <> control),
x AS (SELECT *, abs(z) / sqrt(2) AS x FROM z),
p AS (SELECT *, 1 - {_erf_sql("x")} AS pvalue FROM x),
j AS (SELECT *, row_number() OVER (ORDER BY pvalue, method) AS j, count(*) OVER () AS m FROM p),
h AS (SELECT *, max(least(1.0, (m - j + 1) * pvalue)) OVER (ORDER BY j) AS p_holm FROM j)
SELECT method, control, round(r, 6) AS mean_rank, round(z, 6) AS z, win, tie, loss, round(pvalue, 6) AS pvalue,
       round(p_holm, 6) AS p_holm FROM h JOIN wtl USING (method)""",
)
def q_control_posthoc(spark, sf_dir):
    """A26 with normal p-values and Holm adjustment."""
    res = result_table(spark, sf_dir)
    out = ST.control_posthoc(res, "method", "dataset", "metric")
    return out.select("method", "control", *[r6(c).alias(c) for c in ("mean_rank", "z")], "win", "tie", "loss",
                      *[r6(c).alias(c) for c in ("pvalue", "p_holm")])


@register(
    "pairwise_posthoc_z",
    f"""WITH {RANKS},
mr AS (SELECT method, avg(rank) AS r, count(*) AS n FROM rk GROUP BY method),
kn AS (SELECT count(*) AS k, max(n) AS n FROM mr)
SELECT a.method AS method_a, b.method AS method_b, round(a.r, 6) AS rank_a, round(b.r, 6) AS rank_b,
       round((a.r - b.r) / sqrt(kn.k * (kn.k + 1) / (6.0 * kn.n)), 6) AS z
FROM mr a JOIN mr b ON a.method < b.method, kn""",
)
def q_pairwise_posthoc_z(spark, sf_dir):
    """Z statistic of every method pair."""
    res = result_table(spark, sf_dir)
    out = ST.pairwise_posthoc(res, "method", "dataset", "metric", with_p=False)
    return out.select("method_a", "method_b", r6("rank_a").alias("rank_a"), r6("rank_b").alias("rank_b"), r6("z").alias("z"))


@register(
    "pairwise_posthoc",
    f"""WITH {RANKS},
mr AS (SELECT method, avg(rank) AS r, count(*) AS n FROM rk GROUP BY method),
kn AS (SELECT count(*) AS k, max(n) AS n FROM mr),
z AS (SELECT a.method AS method_a, b.method AS method_b, a.r AS rank_a, b.r AS rank_b,
             (a.r - b.r) / sqrt(kn.k * (kn.k + 1) / (6.0 * kn.n)) AS z
      FROM mr a JOIN mr b ON a.method < b.method, kn),
x AS (SELECT *, abs(z) / sqrt(2) AS x FROM z),
p AS (SELECT *, 1 - {_erf_sql("x")} AS pvalue FROM x),
j AS (SELECT *, row_number() OVER (ORDER BY pvalue, method_a, method_b) AS j, count(*) OVER () AS m FROM p),
-- five methods: 0, 1, 2, 3, 4, 6 or 10 of the ten pairs can be equal
t AS (SELECT *, CASE WHEN m - j + 1 >= 10 THEN 10 WHEN m - j + 1 >= 6 THEN 6 WHEN m - j + 1 >= 4 THEN 4 ELSE m - j + 1 END AS f FROM j),
h AS (SELECT *, max(least(1.0, (m - j + 1) * pvalue)) OVER (ORDER BY j) AS p_holm,
             max(least(1.0, f * pvalue)) OVER (ORDER BY j) AS p_shaffer FROM t)
SELECT method_a, method_b, round(rank_a, 6) AS rank_a, round(rank_b, 6) AS rank_b, round(z, 6) AS z,
       round(pvalue, 6) AS pvalue, round(p_holm, 6) AS p_holm, round(p_shaffer, 6) AS p_shaffer FROM h""",
)
def q_pairwise_posthoc(spark, sf_dir):
    """A27 with p-values, Holm and static Shaffer adjustments over all pairs."""
    res = result_table(spark, sf_dir)
    out = ST.pairwise_posthoc(res, "method", "dataset", "metric")
    return out.select("method_a", "method_b", *[r6(c).alias(c) for c in ("rank_a", "rank_b", "z", "pvalue", "p_holm", "p_shaffer")])


@register(
    "pairwise_posthoc_dynamic",
    f"""WITH RECURSIVE {RANKS},
mr AS (SELECT method, avg(rank) AS r, count(*) AS n FROM rk GROUP BY method),
kn AS (SELECT count(*) AS k, max(n) AS n FROM mr),
z AS (SELECT a.method AS method_a, b.method AS method_b, (a.r - b.r) / sqrt(kn.k * (kn.k + 1) / (6.0 * kn.n)) AS z
      FROM mr a JOIN mr b ON a.method < b.method, kn),
x AS (SELECT *, abs(z) / sqrt(2) AS x FROM z),
p AS (SELECT *, 1 - {_erf_sql("x")} AS pvalue FROM x),
j AS (SELECT *, row_number() OVER (ORDER BY pvalue, method_a, method_b) AS j FROM p),
ms AS (SELECT method, row_number() OVER (ORDER BY method) AS i FROM mr),
-- every partition of the methods into groups of equals: the group of each, first met first
gr AS (SELECT [0] AS g, 0 AS top UNION ALL
       SELECT list_append(g, u.x), greatest(top, u.x) FROM gr, unnest(range(0, top + 2)) AS u(x) WHERE len(g) < (SELECT k FROM kn)),
pa AS (SELECT row_number() OVER () AS q, g FROM gr WHERE len(g) = (SELECT k FROM kn)),
eq AS (SELECT q, j.j, g[a.i] = g[b.i] AS same FROM pa, j JOIN ms a ON a.method = method_a JOIN ms b ON b.method = method_b),
fit AS (SELECT q, sum(same::INTEGER) AS n, min(CASE WHEN same THEN j END) AS first FROM eq GROUP BY q),
f AS (SELECT j.*, (SELECT max(greatest(n, 1)) FROM fit WHERE coalesce(first, 1000) >= j.j) AS f FROM j),
h AS (SELECT *, max(least(1.0, f * pvalue)) OVER (ORDER BY j) AS adjusted FROM f)
SELECT method_a, method_b, round(pvalue, 6) AS pvalue, round(adjusted, 6) AS p_shaffer_dynamic FROM h""",
)
def q_pairwise_posthoc_dynamic(spark, sf_dir):
    """A27 with Shaffer's dynamic procedure: exhaustive sets of the pairs that can be equal."""
    res = result_table(spark, sf_dir)
    out = ST.pairwise_posthoc(res, "method", "dataset", "metric", adjust="shaffer-dynamic")
    return out.select("method_a", "method_b", r6("pvalue").alias("pvalue"), r6("p_shaffer_dynamic").alias("p_shaffer_dynamic"))


@register(
    "mark_best",
    f"""WITH {RES}
SELECT method, dataset, round(metric, 6) AS metric, metric = max(metric) OVER (PARTITION BY dataset) AS is_best FROM res""",
)
def q_mark_best(spark, sf_dir):
    """Best value of each dataset marked."""
    res = result_table(spark, sf_dir)
    out = ST.mark_best(res, "method", "dataset", "metric")
    return out.select("method", "dataset", r6("metric").alias("metric"), "is_best")


@register(
    "parameter_grid",
    """SELECT p.o_orderpriority AS classifier, f.l_returnflag AS flag, d.detector
FROM (SELECT DISTINCT o_orderpriority FROM orders) p, (SELECT DISTINCT l_returnflag FROM lineitem) f,
     (VALUES ('knn'), ('k-means')) d(detector)""",
)
def q_parameter_grid(spark, sf_dir):
    """Cartesian grid of axes taken from the data (bounded distinct sets)."""
    pri = R.axis(table(spark, sf_dir, "orders"), "o_orderpriority", "classifier")
    flags = R.axis(table(spark, sf_dir, "lineitem"), "l_returnflag", "flag")
    return R.grid(spark, classifier=pri, flag=flags, detector=["knn", "k-means"])


@register(
    "zip_axes",
    "WITH q AS ("
    + " UNION ALL ".join(
        f"SELECT {i + 1} AS pos, {p}::DOUBLE AS prob, round(quantile_cont(value, {p}), 6) AS threshold FROM events"
        for i, p in enumerate([0.5, 0.6, 0.7, 0.8, 0.9, 0.95])
    )
    + """),
y AS (SELECT row_number() OVER (ORDER BY y) AS pos, CAST(y AS VARCHAR) AS dataset
      FROM (SELECT DISTINCT year(o_orderdate) AS y FROM orders))
SELECT q.pos::BIGINT AS pos, q.prob, q.threshold, y.dataset FROM q JOIN y ON q.pos = y.pos""",
)
def q_zip_axes(spark, sf_dir):
    """Lock-step zip of thresholds (from events) with datasets (from orders), truncated."""
    probs = [0.5, 0.6, 0.7, 0.8, 0.9, 0.95]
    th = R.exact_quantiles(table(spark, sf_dir, "events"), "value", probs)
    limits = R.axis(th, F.struct("prob", r6("threshold").alias("threshold")), "limits")
    years = R.axis(table(spark, sf_dir, "orders"), F.year("o_orderdate").cast("string"), "dataset")
    return R.zip_axes(spark, limits=limits, dataset=years)


@register(
    "pending_cells",
    """WITH g AS (SELECT o_orderpriority AS method, s.o_orderstatus AS status
           FROM (SELECT DISTINCT o_orderpriority FROM orders), (SELECT DISTINCT o_orderstatus FROM orders) s),
done AS (SELECT DISTINCT o_orderpriority AS method, o_orderstatus AS status FROM orders WHERE o_totalprice > 400000)
SELECT * FROM g WHERE NOT EXISTS (SELECT 1 FROM done WHERE done.method = g.method AND done.status = g.status)""",
)
def q_pending_cells(spark, sf_dir):
    """J8 + S10: grid cells without a result (finished = any order above 400,000)."""
    o = table(spark, sf_dir, "orders")
    g = R.grid(spark, method=R.axis(o, "o_orderpriority", "method"), status=R.axis(o, "o_orderstatus", "status"))
    done = o.where("o_totalprice > 400000").select(
        F.col("o_orderpriority").alias("method"), F.col("o_orderstatus").alias("status"))
    return R.pending_cells(g, done, ["method", "status"])


@register(
    "match_vectors",
    """SELECT vec_id FROM embeddings WHERE embedding::DOUBLE[] IN (SELECT embedding::DOUBLE[] FROM embeddings WHERE label < 3)""",
)
def q_match_vectors(spark, sf_dir):
    """Rows whose vector exactly equals a known-positive vector (left semi join on arrays)."""
    e = table(spark, sf_dir, "embeddings")
    return R.match_vectors(e, e.where("label < 3"), "embedding").select("vec_id")


@register(
    "decode_names",
    """SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'finished' WHEN 'O' THEN 'open' WHEN 'P' THEN 'partial' END AS status_name
FROM orders""",
)
def q_decode_names(spark, sf_dir):
    """Code -> name by a dictionary; unknown codes give null."""
    o = table(spark, sf_dir, "orders")
    return o.select("o_orderkey", R.decode("o_orderstatus", STATUS_NAMES).alias("status_name"))


WIDE_DIM = 64


@register(
    "wide_features",
    "SELECT vec_id, "
    + ", ".join(f"round(embedding[{i + 1}]::DOUBLE, 6) AS __feature__{i}" for i in range(WIDE_DIM))
    + ", round(list_sum(embedding::DOUBLE[]), 6) AS vec_sum FROM embeddings",
)
def q_wide_features(spark, sf_dir):
    """P4 + P5: vector -> wide ``__feature__i`` columns, kept by name and packed back."""
    e = table(spark, sf_dir, "embeddings")
    wide = R.to_wide(e, "embedding", WIDE_DIM, keep=["vec_id"])
    feats = R.keep_features(wide)
    back = R.to_vector(wide, "v", keep=["vec_id"])
    s = back.select("vec_id", F.aggregate("v", F.lit(0.0), lambda a, x: a + x).alias("vec_sum"))
    out = wide.join(s, "vec_id")
    return out.select("vec_id", *[r6(F.col(c).cast("double")).alias(c) for c in feats.columns], r6("vec_sum").alias("vec_sum"))


@register(
    "scalar_functions",
    """SELECT o_orderkey,
  CASE WHEN o_orderpriority = '1-URGENT' THEN '/abs/' || o_orderkey || '.jpg'
       ELSE '/data/img/' || o_orderstatus || '/' || o_orderkey || '.jpg' END AS path,
  CASE WHEN o_totalprice > 100000 THEN 1.0 WHEN o_totalprice < 100000 THEN 0.0 ELSE 0.5 END::DOUBLE AS step,
  (CAST(substr(o_orderpriority, 1, 1) AS INTEGER) * 4 + 1) AS k,
  upper(split_part(lower(o_orderstatus) || '_' || lower(o_orderpriority), '_', 1)) AS train_name,
  """ + sql_round_even("o_totalprice / 1000", 2) + """ AS price_k,
  'S+' || o_orderstatus || '-' || o_orderpriority AS setting
FROM orders""",
)
def q_scalar_functions(spark, sf_dir):
    """F1 path join, F4 pair step, F6 suffix int, F7 title, F8 round half even, F9 format."""
    o = table(spark, sf_dir, "orders")
    rel = F.when(
        F.col("o_orderpriority") == "1-URGENT", F.concat(F.lit("/abs/"), F.col("o_orderkey").cast("string"), F.lit(".jpg"))
    ).otherwise(F.concat(F.col("o_orderstatus"), F.lit("/"), F.col("o_orderkey").cast("string"), F.lit(".jpg")))
    det = F.concat(F.lit("knn-"), (F.substring("o_orderpriority", 1, 1).cast("int") * 4 + 1).cast("string"))
    name = F.concat(F.lower("o_orderstatus"), F.lit("_"), F.lower("o_orderpriority"))
    return o.select(
        "o_orderkey",
        C.path_join("/data/img", rel).alias("path"),
        C.pair_step("o_totalprice", F.lit(100000.0)).alias("step"),
        C.suffix_int(det).alias("k"),
        C.title_setting(name, 0).alias("train_name"),
        C.round_even(F.col("o_totalprice") / 1000, 2).alias("price_k"),
        C.format_setting("S+{}-{}", "o_orderstatus", "o_orderpriority").alias("setting"),
    )


@register(
    "vector_norms",
    """SELECT vec_id, round(sqrt(list_sum(list_transform(embedding::DOUBLE[], lambda x: x * x))), 6) AS norm,
       round(list_distance(embedding::DOUBLE[], list_transform(embedding::DOUBLE[], lambda x: 0.0)), 6) AS dist0
FROM embeddings""",
)
def q_vector_norms(spark, sf_dir):
    """Euclidean norm and distance to the origin of every feature vector."""
    e = table(spark, sf_dir, "embeddings")
    zero = F.transform("embedding", lambda x: F.lit(0.0))
    return e.select("vec_id", r6(C.l2_norm("embedding")).alias("norm"), r6(C.l2_distance("embedding", zero)).alias("dist0"))


@register(
    "aul_per_result_row",
    """WITH li AS (SELECT l_orderkey, l_discount AS s, (l_returnflag = 'R')::INTEGER AS y FROM lineitem),
pairs AS (SELECT a.l_orderkey, sum(CASE WHEN a.s > b.s THEN 1.0 WHEN a.s < b.s THEN 0.0 ELSE 0.5 END) AS acc
          FROM li a JOIN li b ON a.l_orderkey = b.l_orderkey WHERE a.y = 1 GROUP BY a.l_orderkey),
cnt AS (SELECT l_orderkey, sum(y) AS np, count(*) AS n FROM li GROUP BY l_orderkey)
SELECT cnt.l_orderkey, round(pairs.acc / (cnt.np * cnt.n), 6) AS aul
FROM cnt LEFT JOIN pairs ON cnt.l_orderkey = pairs.l_orderkey""",
)
def q_aul_per_result_row(spark, sf_dir):
    """A24 + F2 + F3 + F10: every order is a stored result row whose ``y_true`` and
    ``y_pred`` are text lists (``y_pred`` holds both class columns, so every second value
    is kept); lists are parsed, zipped, exploded, and AUL is computed per row."""
    li = table(spark, sf_dir, "lineitem")
    items = li.select(
        "l_orderkey", "l_linenumber", "l_discount", C.label(F.col("l_returnflag") == "R").alias("y")
    )
    # a stored result row holds at most 1,000 entries: a hot order becomes several rows
    stored = items.groupBy("l_orderkey", F.floor(F.col("l_linenumber") / 1000).alias("chunk")).agg(
        F.collect_list(F.struct("l_discount", "y")).alias("_it")
    ).select(
        "l_orderkey",
        "chunk",
        F.concat(F.lit("["), F.array_join(F.transform("_it", lambda s: s["y"].cast("string")), ", "), F.lit("]")).alias("y_true"),
        F.concat(
            F.lit("["),
            F.array_join(
                F.transform("_it", lambda s: F.concat((F.lit(1.0) - s["l_discount"]).cast("string"), F.lit(", "),
                                                     s["l_discount"].cast("string"))), ", "),
            F.lit("]"),
        ).alias("y_pred"),
    )
    parsed = stored.select(
        "l_orderkey", C.parse_list("y_true").alias("yt"), C.parse_list("y_pred").alias("yp")
    ).select("l_orderkey", "yt", C.every_second_if_double("yp", "yt").alias("yp"))
    rows = parsed.select("l_orderkey", C.zip_explode("yt", "yp", ("y", "score"))).select(
        "l_orderkey", F.col("col.y").cast("int").alias("y"), F.col("col.score").alias("score")
    )
    out = M.aul(rows, "y", "score", ["l_orderkey"])
    return out.select("l_orderkey", r6("aul").alias("aul"))
