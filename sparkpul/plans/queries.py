"""Registered queries: one per operator of the inventory, each with its DuckDB oracle.

Every query reads the benchmark tables in ``sf_dir`` whole. Doubles are rounded to
6 digits in both engines; integer outputs are ``bigint`` and labels ``int``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import label
from ..operators import metrics as M
from ..operators import splits as S
from ..operators.detectors import KMeansDetector, KNNDetector, RandomDetector
from ..operators.knn import credibility, knn_classify, knn_join
from ..operators.ranking import tail_cuts
from ..operators.results import exact_quantiles
from .tables import (
    EVENTS_POSITIVE_FROM,
    EVENTS_RELIABLE_ABOVE,
    embedding_pu,
    events_positive,
    events_reliable,
    table,
)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql.strip()
        return fn

    return deco


def r6(c):
    return F.round(F.col(c) if isinstance(c, str) else c, 6)


def sql_round_even(x: str, digits: int = 2) -> str:
    """DuckDB form of ``functions.round_even``: half-even on the exact binary value.

    DuckDB's ``round_even`` scales by 10^digits in floating point first, which can
    land exactly on a tie (182.025 * 100 = 18202.5) that the binary value does not
    have; near a tie the same Dekker split decides.
    """
    s = float(10**digits)
    y = f"(({x}) * {s})"
    k = f"floor({y})"
    hi = f"((134217729.0 * ({x})) - ((134217729.0 * ({x})) - ({x})))"
    lo = f"(({x}) - {hi})"
    d = f"(({s} * {hi} - ({k} + 0.5)) + {s} * {lo})"
    return (
        f"(CASE WHEN abs({y} - {k} - 0.5) < 1e-6 THEN "
        f"(CASE WHEN {d} < 0 THEN {k} / {s} WHEN {d} > 0 THEN ({k} + 1) / {s} "
        f"WHEN {k} % 2 = 0 THEN {k} / {s} ELSE ({k} + 1) / {s} END) "
        f"ELSE round_even({x}, {digits}) END)"
    )


# ----------------------------------------------------------------------------- SQL pieces

EMB = """e AS (SELECT vec_id, embedding::DOUBLE[] AS v,
                 CASE WHEN coalesce(label < 3, false) THEN 1 ELSE 0 END::INTEGER AS y_pu,
                 CASE WHEN coalesce(label < 5, false) THEN 1 ELSE 0 END::INTEGER AS y_true
          FROM embeddings)"""

EVENTS = """ev AS (SELECT *,
                 CASE WHEN coalesce(value >= 50 AND NOT isnan(value), false) THEN 1 ELSE 0 END::INTEGER AS y_true,
                 CASE WHEN coalesce(value > 100 AND NOT isnan(value), false) THEN 1 ELSE 0 END::INTEGER AS y_pu,
                 md5('1234:' || event_id) AS hk
          FROM events)"""

EVENTS_TEST = EVENTS + """,
ev_r AS (SELECT *, row_number() OVER (PARTITION BY y_true ORDER BY hk, event_id) AS rk,
                floor(count(*) OVER (PARTITION BY y_true) * 0.2) AS amt FROM ev),
ev_s AS (SELECT *, CASE WHEN rk <= amt THEN 'test' ELSE 'train' END AS split FROM ev_r)"""


# ----------------------------------------------------------------------------- kNN

@register(
    "knn_negatives",
    f"""
WITH {EMB},
p AS (SELECT * FROM e WHERE y_pu = 1), u AS (SELECT * FROM e WHERE y_pu = 0),
d AS (SELECT u.vec_id, p.vec_id AS nn, list_distance(u.v, p.v) AS dist FROM u, p),
r AS (SELECT vec_id, dist, row_number() OVER (PARTITION BY vec_id ORDER BY round(dist, 9), nn) AS rk FROM d),
m AS (SELECT vec_id, avg(dist) AS mean_dist FROM r WHERE rk <= 5 GROUP BY vec_id),
o AS (SELECT vec_id, mean_dist, row_number() OVER (ORDER BY round(mean_dist, 9) DESC, vec_id) AS pos FROM m)
SELECT vec_id, round(mean_dist, 6) AS mean_dist FROM o
WHERE pos <= (SELECT floor(count(*) * 0.1) FROM u)
""",
)
def knn_negatives(spark, sf_dir):
    """M2 + A9 + T1: the farthest 10 % of unlabeled rows from their 5 nearest positives."""
    pu = embedding_pu(spark, sf_dir)
    det = KNNDetector(frac=0.1, k=5)
    neg = det.negatives(pu, "vec_id")
    return neg.select("vec_id", r6("mean_dist").alias("mean_dist"))


@register(
    "knn_join",
    f"""
WITH {EMB},
p AS (SELECT * FROM e WHERE y_pu = 1), u AS (SELECT * FROM e WHERE y_pu = 0),
d AS (SELECT u.vec_id, p.vec_id AS nn_id, list_distance(u.v, p.v) AS dist FROM u, p),
r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY round(dist, 9), nn_id) AS rk FROM d)
SELECT vec_id, nn_id, round(dist, 6) AS distance, rk::BIGINT AS nn_rank FROM r WHERE rk <= 3
""",
)
def q_knn_join(spark, sf_dir):
    """J2 + T3: 3 nearest known positives of every unlabeled row."""
    pu = embedding_pu(spark, sf_dir)
    nn = knn_join(pu.where("y_pu = 0"), pu.where("y_pu = 1"), 3, "vec_id", "vec_id")
    return nn.select("vec_id", "nn_id", r6("distance").alias("distance"), F.col("nn_rank").cast("long"))


@register("knn_join_blocks", ORACLE["knn_join"])
def q_knn_join_blocks(spark, sf_dir):
    """J2 + T3 by the tile plan, with tiles small enough that both sides have several."""
    pu = embedding_pu(spark, sf_dir)
    nn = knn_join(pu.where("y_pu = 0"), pu.where("y_pu = 1"), 3, "vec_id", "vec_id", method="blocks",
                  block_rows=64, query_rows_per_group=64)
    return nn.select("vec_id", "nn_id", r6("distance").alias("distance"), F.col("nn_rank").cast("long"))


@register("knn_join_quantised", ORACLE["knn_join"])
def q_knn_join_quantised(spark, sf_dir):
    """J2 + T3 by one-byte bounds: exact distances for the pairs that the bounds leave."""
    pu = embedding_pu(spark, sf_dir)
    nn = knn_join(pu.where("y_pu = 0"), pu.where("y_pu = 1"), 3, "vec_id", "vec_id", method="quantised",
                  block_rows=512, query_rows_per_group=512)
    return nn.select("vec_id", "nn_id", r6("distance").alias("distance"), F.col("nn_rank").cast("long"))


@register(
    "knn_credibility",
    f"""
WITH {EMB},
d AS (SELECT a.vec_id, b.vec_id AS nn, b.y_pu, list_distance(a.v, b.v) AS dist FROM e a, e b),
r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY round(dist, 9), nn) AS rk FROM d)
SELECT vec_id, round(avg(y_pu), 6) AS credibility FROM r
WHERE rk <= 5 AND vec_id IN (SELECT vec_id FROM e WHERE y_pu = 0)
GROUP BY vec_id
""",
)
def q_knn_credibility(spark, sf_dir):
    """J3 + J4 + A10: share of known positives among the 5 nearest rows (self included)."""
    pu = embedding_pu(spark, sf_dir)
    return credibility(pu, 5, "vec_id").select("vec_id", r6("credibility").alias("credibility"))


@register(
    "knn_classifier",
    f"""
WITH {EMB},
h AS (SELECT *, md5('1234:' || vec_id) AS hk FROM e),
hr AS (SELECT *, row_number() OVER (PARTITION BY y_true ORDER BY hk, vec_id) AS rk,
              floor(count(*) OVER (PARTITION BY y_true) * 0.25) AS amt FROM h),
te AS (SELECT * FROM hr WHERE rk <= amt), tr AS (SELECT * FROM hr WHERE rk > amt),
d AS (SELECT te.vec_id, tr.vec_id AS nn, tr.y_true AS y, list_distance(te.v, tr.v) AS dist FROM te, tr),
r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY round(dist, 9), nn) AS rk FROM d),
s AS (SELECT vec_id, avg(y) AS share FROM r WHERE rk <= 5 GROUP BY vec_id)
SELECT vec_id, round(share, 6) AS vote_share, (share > 0.5)::INTEGER AS prediction FROM s
""",
)
def q_knn_classifier(spark, sf_dir):
    """5-NN vote on a stratified 25 % test split of the feature table."""
    pu = embedding_pu(spark, sf_dir)
    sp = S.stratified_split(pu, "vec_id", "y_true", 0.25)
    train = sp.where("split = 'train'").withColumnRenamed("y_true", "y")
    test = sp.where("split = 'val'")
    out = knn_classify(train, test, 5, "vec_id", y_col="y")
    return out.select("vec_id", r6("vote_share").alias("vote_share"), F.col("prediction").cast("int"))


# ----------------------------------------------------------------------------- splits

@register(
    "pn_test_split",
    f"""
WITH {EVENTS_TEST}
SELECT event_id, y_true, y_pu, split FROM ev_s
""",
)
def q_pn_test_split(spark, sf_dir):
    """D1 + P1-P3: exact 20 % of each true class as test; reliable flag on all rows."""
    ev = table(spark, sf_dir, "events")
    out = S.pn_test_split(ev, "event_id", events_reliable(), events_positive(), 0.2)
    return out.select("event_id", "y_true", "y_pu", "split")


BUILD_PU_SQL = f"""
WITH {EVENTS_TEST},
tr AS (SELECT * FROM ev_s WHERE split = 'train'),
c AS (SELECT sum(y_pu)::BIGINT AS np, (count(*) - sum(y_pu))::BIGINT AS nu FROM tr),
pl AS (SELECT np, nu, floor(floor((np + nu) * 1.0) * 0.1)::BIGINT AS val_amount FROM c),
pl2 AS (SELECT *, floor(val_amount * (np / (np + nu)))::BIGINT AS vp FROM pl),
pl3 AS (SELECT *, val_amount - vp AS vu, floor((np - vp) * 0.2)::BIGINT AS mv FROM pl2),
tr_r AS (SELECT tr.*, row_number() OVER (PARTITION BY y_pu ORDER BY md5('1234:val:' || event_id), event_id) AS r2 FROM tr)
"""


@register(
    "build_pu",
    BUILD_PU_SQL
    + """
SELECT event_id, y_true,
       CASE WHEN y_pu = 1 AND r2 > vp AND r2 <= vp + mv THEN 0 ELSE y_pu END::INTEGER AS y_pu,
       CASE WHEN (y_pu = 1 AND r2 <= vp) OR (y_pu = 0 AND r2 <= vu) THEN 'val' ELSE 'train' END AS split,
       (y_pu = 1 AND r2 > vp AND r2 <= vp + mv) AS moved
FROM tr_r, pl3
UNION ALL
SELECT event_id, y_true, y_pu, split, false AS moved FROM ev_s WHERE split = 'test'
""",
)
def q_build_pu(spark, sf_dir):
    """D2 (+ D7 recipe on one table): test 20 %, validation 10 % with the train P share,
    20 % of the remaining positives hidden in U."""
    ev = table(spark, sf_dir, "events")
    out = S.build_pu(ev, "event_id", events_reliable(), events_positive(), test_frac=0.2, val_split=0.1,
                     val_share="same", move_frac=0.2)
    return out.select("event_id", "y_true", "y_pu", "split", "moved")


@register(
    "split_plan",
    BUILD_PU_SQL.split(",\ntr_r")[0]
    + """
SELECT np AS positives, nu AS unlabeled, floor((np + nu) * 1.0)::BIGINT AS requested, val_amount AS val_rows,
       vp AS val_positives, mv AS hidden_positives, floor((np - vp) * (1.0 - 0.2))::BIGINT AS known_positives,
       vu AS val_unlabeled, (np + nu - val_amount)::BIGINT AS train_rows, (nu - vu + mv)::BIGINT AS train_unlabeled
FROM pl3
""",
)
def q_split_plan(spark, sf_dir):
    """Split sizes of the build_pu query."""
    ev = table(spark, sf_dir, "events")
    _, plan = S.build_pu(ev, "event_id", events_reliable(), events_positive(), test_frac=0.2, val_split=0.1,
                         val_share="same", move_frac=0.2, return_plan=True)
    return S.split_plan_frame(spark, plan)


@register(
    "stratified_split",
    f"""
WITH {EMB},
h AS (SELECT *, row_number() OVER (PARTITION BY y_true ORDER BY md5('1234:' || vec_id), vec_id) AS rk,
             floor(count(*) OVER (PARTITION BY y_true) * 0.25) AS amt FROM e)
SELECT vec_id, y_true, CASE WHEN rk <= amt THEN 'val' ELSE 'train' END AS split FROM h
""",
)
def q_stratified_split(spark, sf_dir):
    """D3 + W2: stratified 25 % validation split of the feature table."""
    pu = embedding_pu(spark, sf_dir)
    return S.stratified_split(pu, "vec_id", "y_true", 0.25).select("vec_id", "y_true", "split")


@register(
    "permutation",
    """
SELECT event_id, row_number() OVER (ORDER BY md5('1234:' || event_id), event_id)::BIGINT AS pos FROM events
""",
)
def q_permutation(spark, sf_dir):
    """A reproducible random permutation of all events as explicit positions."""
    ev = table(spark, sf_dir, "events").select("event_id")
    return S.permutation(ev, "event_id")


@register(
    "fixed_size_subset",
    """
SELECT event_id, (row_number() OVER (ORDER BY md5('1234:' || event_id), event_id) <= 2500) AS sampled FROM events
""",
)
def q_fixed_size_subset(spark, sf_dir):
    """Exactly 2,500 random events and the rest."""
    ev = table(spark, sf_dir, "events").select("event_id")
    return S.exact_sample(ev, "event_id", n=2500)


@register(
    "bernoulli_tags",
    f"""
WITH {EMB},
d AS (SELECT a.vec_id, b.vec_id AS nn, b.y_pu, list_distance(a.v, b.v) AS dist FROM e a, e b),
r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY round(dist, 9), nn) AS rk FROM d),
c AS (SELECT vec_id, avg(y_pu) AS cred FROM r
      WHERE rk <= 5 AND vec_id IN (SELECT vec_id FROM e WHERE y_pu = 0) GROUP BY vec_id),
t AS (SELECT vec_id, cred, unnest(range(0, 4)) AS copy FROM c)
SELECT vec_id, copy::INTEGER AS copy,
       ((('0x' || substr(md5('1234:' || vec_id || ':' || copy), 1, 13))::BIGINT::DOUBLE / 4503599627370496.0) < cred)::INTEGER AS tag
FROM t
""",
)
def q_bernoulli_tags(spark, sf_dir):
    """D5 (ProbTagging data step): 4 tagged copies of U by kNN credibility."""
    pu = embedding_pu(spark, sf_dir)
    cred = credibility(pu, 5, "vec_id")
    return S.bernoulli_tags(cred, "vec_id", "credibility", 4).select(
        "vec_id", F.col("copy").cast("int"), F.col("tag").cast("int")
    )


@register(
    "cross_source_pu",
    """
WITH a AS (SELECT d.doc_id FROM documents d JOIN labels l ON d.doc_id = l.doc_id WHERE l.quality = 1),
b AS (SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM a)),
u AS (SELECT doc_id, 1 AS y_pu FROM a UNION ALL SELECT doc_id, 0 AS y_pu FROM b),
h AS (SELECT *, row_number() OVER (PARTITION BY y_pu ORDER BY md5('1234:' || doc_id), doc_id) AS rk,
             floor(count(*) OVER (PARTITION BY y_pu) * 0.1) AS amt FROM u)
SELECT doc_id, y_pu::INTEGER AS y_pu, CASE WHEN rk <= amt THEN 'val' ELSE 'train' END AS split FROM h
""",
)
def q_cross_source_pu(spark, sf_dir):
    """D10 + J1 + J5: documents labelled quality 1 are the positive source, all other
    documents the unlabeled source; stratified 10 % validation."""
    docs = table(spark, sf_dir, "documents").select("doc_id")
    lab = table(spark, sf_dir, "labels")
    p = docs.join(lab.where("quality = 1").select("doc_id"), "doc_id", "left_semi")
    u = docs.join(p, "doc_id", "left_anti")
    out = S.cross_source_pu(p, u, "doc_id", 0.1)
    return out.select("doc_id", F.col("y_pu").cast("int"), "split")


@register(
    "threshold_labels",
    f"""
WITH {EVENTS}
SELECT event_id, y_pu, y_true FROM ev
""",
)
def q_threshold_labels(spark, sf_dir):
    """P1-P3 with N1/N2: reliable ``value > 100``, true ``value >= 50``; NaN/null -> 0."""
    ev = table(spark, sf_dir, "events")
    return ev.select("event_id", label(events_reliable()).alias("y_pu"), label(events_positive()).alias("y_true"))


@register(
    "whole_as_test",
    f"""
WITH {EVENTS}
SELECT event_id, y_true, y_pu, 'test' AS split FROM ev
""",
)
def q_whole_as_test(spark, sf_dir):
    """The whole table as a PN test set (test_frac = 1)."""
    ev = table(spark, sf_dir, "events")
    out = S.whole_as_test(ev, "event_id", events_reliable(), events_positive())
    return out.select("event_id", "y_true", "y_pu", "split")


@register(
    "presplit_recipe",
    f"""
WITH {EVENTS}
SELECT event_id, y_true, y_pu,
       CASE WHEN event_type = 'error' THEN 'val' WHEN event_type = 'purchase' THEN 'test' ELSE 'train' END AS split
FROM ev
""",
)
def q_presplit_recipe(spark, sf_dir):
    """A dataset that comes as train / val / test tables (here: by event type)."""
    ev = table(spark, sf_dir, "events")
    # every other event type, new ones and null included, is training data
    train = ev.where(~F.coalesce(F.col("event_type").isin("error", "purchase"), F.lit(False)))
    val = ev.where(F.col("event_type") == "error")
    test = ev.where(F.col("event_type") == "purchase")
    out = S.presplit_recipe(train, val, test, "event_id", events_reliable(), events_positive())
    return out.select("event_id", "y_true", "y_pu", "split")


@register(
    "score_rank",
    """
SELECT event_id, row_number() OVER (ORDER BY value, event_id)::BIGINT AS rank FROM events
""",
)
def q_score_rank(spark, sf_dir):
    """Exact global rank of every event by score (ties by id) without a one-task window."""
    from ..operators.ranking import global_rank

    ev = table(spark, sf_dir, "events").select("event_id", "value")
    return global_rank(ev, "value", "event_id").select("event_id", "rank")


@register(
    "score_rank_text_ids",
    """
SELECT doc_id, row_number() OVER (ORDER BY lang, md5(text) || ':' || doc_id)::BIGINT AS rank FROM documents
""",
)
def q_score_rank_text_ids(spark, sf_dir):
    """W1 over text: rank of every document by language, ties by a text id."""
    from ..operators.ranking import global_rank

    d = table(spark, sf_dir, "documents").select(
        "doc_id", "lang", F.concat(F.md5("text"), F.lit(":"), F.col("doc_id").cast("string")).alias("key")
    )
    return global_rank(d, "lang", "key").select("doc_id", "rank")


@register(
    "move_tails_nulls",
    """
WITH e AS (SELECT event_id, user_id % 5 AS g, CASE WHEN event_id % 3 = 0 THEN NULL ELSE value END AS s FROM events),
r AS (SELECT *, row_number() OVER (ORDER BY s, event_id) AS lo, row_number() OVER (ORDER BY s DESC, event_id) AS hi,
             floor(count(*) OVER () * 0.1) AS m FROM e WHERE s IS NOT NULL)
SELECT e.event_id, coalesce(lo <= m, false) AS low, coalesce(hi <= m, false) AS high FROM e LEFT JOIN r USING (event_id)
""",
)
def q_move_tails_nulls(spark, sf_dir):
    """T2 with missing scores: 10 % of the scored events at either end; the others in neither."""
    from ..operators.ranking import tail_cuts

    e = table(spark, sf_dir, "events").select(
        "event_id", F.when(F.col("event_id") % 3 != 0, F.col("value")).alias("s")
    )
    return tail_cuts(e, "s", "event_id", 0.1).select("event_id", "low", "high")


@register(
    "stratified_split_null_class",
    """
WITH o AS (SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN NULL ELSE o_custkey % 2000 END AS c FROM orders),
h AS (SELECT *, row_number() OVER (PARTITION BY c ORDER BY md5('1234:' || o_orderkey), o_orderkey) AS rk,
             floor(count(*) OVER (PARTITION BY c) * 0.25) AS amt FROM o)
SELECT o_orderkey, coalesce(c, -1) AS c, CASE WHEN rk <= amt THEN 'val' ELSE 'train' END AS split FROM h
""",
)
def q_stratified_split_null_class(spark, sf_dir):
    """D3 with up to 2,000 classes and a null class, each drawn on its own."""
    o = table(spark, sf_dir, "orders").select(
        "o_orderkey", F.when(F.col("o_orderstatus") != "P", F.col("o_custkey") % 2000).alias("c")
    )
    out = S.stratified_split(o, "o_orderkey", "c", 0.25)
    return out.select("o_orderkey", F.coalesce("c", F.lit(-1).cast("long")).alias("c"), "split")


@register(
    "single_table_recipe",
    f"""
WITH {EVENTS_TEST},
tr AS (SELECT * FROM ev_s WHERE split = 'train'),
c AS (SELECT sum(y_pu)::BIGINT AS np, (count(*) - sum(y_pu))::BIGINT AS nu FROM tr),
pl AS (SELECT np, nu, floor((np + nu) * 0.2)::BIGINT AS val_amount FROM c),
pl2 AS (SELECT *, floor(val_amount * (np / (np + nu)))::BIGINT AS vp FROM pl),
pl3 AS (SELECT *, val_amount - vp AS vu FROM pl2),
tr_r AS (SELECT tr.*, row_number() OVER (PARTITION BY y_pu ORDER BY md5('1234:val:' || event_id), event_id) AS r2 FROM tr)
SELECT event_id, y_true, y_pu,
       CASE WHEN (y_pu = 1 AND r2 <= vp) OR (y_pu = 0 AND r2 <= vu) THEN 'val' ELSE 'train' END AS split
FROM tr_r, pl3
UNION ALL
SELECT event_id, y_true, y_pu, split FROM ev_s WHERE split = 'test'
""",
)
def q_single_table_recipe(spark, sf_dir):
    """The single-table recipe with its defaults (20 % test, 20 % validation, nothing hidden)."""
    ev = table(spark, sf_dir, "events")
    out = S.single_table_recipe(ev, "event_id", "value", EVENTS_RELIABLE_ABOVE, EVENTS_POSITIVE_FROM)
    return out.select("event_id", "y_true", "y_pu", "split")


QUANTILE_PROBS = [0.5, 0.55, 0.6, 0.65, 0.7, 0.75, 0.8, 0.85, 0.9, 0.95, 0.99]


@register(
    "quantile_thresholds",
    "\nUNION ALL\n".join(
        f"SELECT {p}::DOUBLE AS prob, round(quantile_cont(value, {p}), 6) AS threshold FROM events" for p in QUANTILE_PROBS
    ),
)
def q_quantile_thresholds(spark, sf_dir):
    """Exact thresholds at quantiles 0.5 ... 0.95 and 0.99 of the event score."""
    ev = table(spark, sf_dir, "events")
    return exact_quantiles(ev, "value", QUANTILE_PROBS).select("prob", r6("threshold").alias("threshold"))


# ----------------------------------------------------------------------------- metrics

LI = """li AS (SELECT l_linestatus, l_discount AS score, (l_returnflag = 'R')::INTEGER AS y,
              (l_discount > 0.05)::INTEGER AS pred FROM lineitem)"""


@register(
    "classification_metrics",
    f"""
WITH {LI},
c AS (SELECT l_linestatus, sum((y = 1 AND pred = 1)::INTEGER)::BIGINT AS tp, sum((y = 0 AND pred = 1)::INTEGER)::BIGINT AS fp,
             sum((y = 0 AND pred = 0)::INTEGER)::BIGINT AS tn, sum((y = 1 AND pred = 0)::INTEGER)::BIGINT AS fn,
             count(*)::BIGINT AS n FROM li GROUP BY l_linestatus)
SELECT l_linestatus, tp, fp, tn, fn, n,
       round((tp + tn) / n, 6) AS accuracy,
       round(CASE WHEN tp + fn > 0 AND tn + fp > 0 THEN (tp / (tp + fn) + tn / (tn + fp)) / 2
                  WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE tn / (tn + fp) END, 6) AS balanced_accuracy,
       round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) AS f1,
       round((tp + fp) / n, 6) AS positive_rate
FROM c
""",
)
def q_classification_metrics(spark, sf_dir):
    """Confusion counts and metrics per line status; truth = return flag R,
    prediction = discount above 5 %."""
    li = table(spark, sf_dir, "lineitem").select(
        "l_linestatus", label(F.col("l_returnflag") == "R").alias("y"), label(F.col("l_discount") > 0.05).alias("pred")
    )
    m = M.classification_metrics(li, "y", "pred", ["l_linestatus"])
    return m.select("l_linestatus", "tp", "fp", "tn", "fn", "n", *[r6(c).alias(c) for c in
                    ("accuracy", "balanced_accuracy", "f1", "positive_rate")])


@register(
    "pu_f1",
    f"""
WITH {LI},
c AS (SELECT l_linestatus, sum((y = 1 AND pred = 1)::INTEGER) AS tp, sum(y) AS p, sum(pred) AS pp, count(*) AS n
      FROM li GROUP BY l_linestatus)
SELECT l_linestatus, round(tp / nullif(p, 0), 6) AS recall, round(pp / n, 6) AS positive_rate,
       round((tp / nullif(p, 0)) * (tp / nullif(p, 0)) / nullif(pp / n, 0), 6) AS pu_f1
FROM c
""",
)
def q_pu_f1(spark, sf_dir):
    """A5: PU-F1 per line status."""
    li = table(spark, sf_dir, "lineitem").select(
        "l_linestatus", label(F.col("l_returnflag") == "R").alias("y"), label(F.col("l_discount") > 0.05).alias("pred")
    )
    out = M.pu_f1(li, "y", "pred", ["l_linestatus"])
    return out.select("l_linestatus", *[r6(c).alias(c) for c in ("recall", "positive_rate", "pu_f1")])


@register(
    "aul",
    f"""
WITH {LI},
s AS (SELECT l_linestatus, score, count(*) AS cnt, sum(y) AS pos FROM li GROUP BY l_linestatus, score),
w AS (SELECT *, coalesce(sum(cnt) OVER (PARTITION BY l_linestatus ORDER BY score
                 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM s)
SELECT l_linestatus, sum(pos)::BIGINT AS n_pos, sum(cnt)::BIGINT AS n,
       round(sum(pos * (before + 0.5 * cnt)) / nullif(sum(pos) * sum(cnt), 0), 6) AS aul
FROM w GROUP BY l_linestatus
""",
)
def q_aul(spark, sf_dir):
    """A6 + W4: AUL of the discount score against return flag R, per line status
    (11 distinct scores: heavy ties)."""
    li = table(spark, sf_dir, "lineitem").select(
        "l_linestatus", "l_discount", label(F.col("l_returnflag") == "R").alias("y")
    )
    out = M.aul(li, "y", "l_discount", ["l_linestatus"])
    return out.select("l_linestatus", "n_pos", "n", r6("aul").alias("aul"))


@register(
    "lift_curve",
    """
WITH s AS (SELECT o_totalprice AS score, count(*) AS cnt, sum((o_orderstatus = 'F')::INTEGER) AS pos
           FROM orders GROUP BY o_totalprice),
w AS (SELECT *, coalesce(sum(cnt) OVER (ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS cb,
                coalesce(sum(pos) OVER (ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pb,
                sum(cnt) OVER () AS n, sum(pos) OVER () AS p FROM s)
SELECT score, cnt::BIGINT AS n_points, (cb + 1)::BIGINT AS first_pos, round((n - cb - cnt) / n, 6) AS y_rate,
       round((p - pb - pos) / p, 6) AS tpr FROM w
UNION ALL SELECT NULL, 1, 0, 1.0, 1.0
""",
)
def q_lift_curve(spark, sf_dir):
    """PU lift curve of the order price as score for status F (compact form)."""
    o = table(spark, sf_dir, "orders").select("o_totalprice", label(F.col("o_orderstatus") == "F").alias("y"))
    out = M.lift_curve(o, "y", "o_totalprice")
    return out.select("score", "n_points", "first_pos", r6("y_rate").alias("y_rate"), r6("tpr").alias("tpr"))


@register(
    "class_prior",
    f"""
WITH {EMB}
SELECT round(avg(y_pu), 6) AS prior_known, round(avg(y_true), 6) AS prior_true FROM e
""",
)
def q_class_prior(spark, sf_dir):
    """Share of known and of true positives in the feature table."""
    pu = embedding_pu(spark, sf_dir)
    both = pu.agg(F.avg(F.col("y_pu").cast("double")).alias("prior_known"),
                  F.avg(F.col("y_true").cast("double")).alias("prior_true"))
    return both.select(r6("prior_known").alias("prior_known"), r6("prior_true").alias("prior_true"))


@register(
    "nnpu_risk",
    """
WITH li AS (SELECT l_linestatus, (l_returnflag = 'R')::INTEGER AS y,
                   least(greatest(l_discount * 10.0, 1e-7), 1 - 1e-7) AS p FROM lineitem),
a AS (SELECT l_linestatus, avg(CASE WHEN y = 1 THEN -ln(p) END) AS pp, avg(CASE WHEN y = 0 THEN -ln(1 - p) END) AS un,
             avg(CASE WHEN y = 1 THEN -ln(1 - p) END) AS pn FROM li GROUP BY l_linestatus)
SELECT l_linestatus, round(0.3 * pp, 6) AS positive_risk, round(un - 0.3 * pn, 6) AS negative_risk,
       round(0.3 * pp + greatest(0.0, un - 0.3 * pn), 6) AS nnpu_risk FROM a
""",
)
def q_nnpu_risk(spark, sf_dir):
    """A21 + F11: non-negative PU risk, probability = 10 x discount, prior 0.3."""
    li = table(spark, sf_dir, "lineitem").select(
        "l_linestatus", label(F.col("l_returnflag") == "R").alias("y"), (F.col("l_discount") * 10.0).alias("p")
    )
    out = M.nnpu_risk(li, "y", "p", 0.3, ["l_linestatus"])
    return out.select("l_linestatus", *[r6(c).alias(c) for c in ("positive_risk", "negative_risk", "nnpu_risk")])


# ----------------------------------------------------------------------------- detectors

@register(
    "random_negatives",
    f"""
WITH {EMB},
u AS (SELECT *, row_number() OVER (ORDER BY md5('1234:' || vec_id), vec_id) AS rk FROM e WHERE y_pu = 0)
SELECT vec_id FROM u WHERE rk <= (SELECT floor(count(*) * 0.2) FROM u)
""",
)
def q_random_negatives(spark, sf_dir):
    """M1: a random 20 % of the unlabeled rows."""
    pu = embedding_pu(spark, sf_dir)
    return RandomDetector(0.2).negatives(pu, "vec_id").select("vec_id")


KMEANS_SQL = f"""
WITH {EMB},
ex AS (SELECT label AS cid, unnest(embedding)::DOUBLE AS x, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings),
cm AS (SELECT cid, i, avg(x) AS m FROM ex GROUP BY cid, i),
c AS (SELECT cid, list(m ORDER BY i) AS cv FROM cm GROUP BY cid),
cc AS (SELECT (row_number() OVER (ORDER BY cid) - 1) AS ci, cv FROM c),
ed AS (SELECT e.vec_id, e.y_pu, cc.ci, list_distance(e.v, cc.cv) AS d FROM e, cc),
asr AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY d, ci) AS rn FROM ed),
asg AS (SELECT vec_id, y_pu, ci AS cluster FROM asr WHERE rn = 1),
sh AS (SELECT cluster, avg(y_pu) AS share FROM asg GROUP BY cluster),
ord AS (SELECT cluster, row_number() OVER (ORDER BY share, cluster) - 1 AS i, count(*) OVER () AS nc FROM sh),
neg AS (SELECT cluster FROM ord WHERE i < nc / 2.0), pos AS (SELECT cluster FROM ord WHERE NOT (i < nc / 2.0)),
nd AS (SELECT neg.cluster, avg(list_distance(a.cv, b.cv)) AS md FROM neg JOIN cc a ON a.ci = neg.cluster
       CROSS JOIN pos JOIN cc b ON b.ci = pos.cluster GROUP BY neg.cluster),
rk AS (SELECT cluster, row_number() OVER (ORDER BY round(md, 9) DESC, cluster) AS crank FROM nd),
u AS (SELECT asg.vec_id, rk.crank FROM asg JOIN rk ON asg.cluster = rk.cluster WHERE asg.y_pu = 0),
o AS (SELECT vec_id, row_number() OVER (ORDER BY crank, md5('1234:' || vec_id), vec_id) AS pos FROM u)
SELECT vec_id FROM o WHERE pos <= (SELECT floor(count(*) * 0.3) FROM e WHERE y_pu = 0)
"""


@register("kmeans_negatives", KMEANS_SQL)
def q_kmeans_negatives(spark, sf_dir):
    """M3 with given centroids (the per-label mean vectors, 10 clusters) + J6, A11, A12,
    T4, T5: 30 % of U from the negative clusters farthest from the positive ones."""
    import numpy as np

    emb = table(spark, sf_dir, "embeddings")
    dim = emb.select(F.size("embedding").alias("d")).first()["d"]
    cents = (
        emb.groupBy("label")
        .agg(F.array(*[F.avg(F.col("embedding")[i].cast("double")) for i in range(dim)]).alias("c"))
        .orderBy("label")
        .collect()
    )
    centroids = np.array([r["c"] for r in cents])
    pu = embedding_pu(spark, sf_dir)
    return KMeansDetector(0.3, len(centroids), centroids=centroids).negatives(pu, "vec_id").select("vec_id")


@register("kmeans_negatives_fit")
def q_kmeans_negatives_fit(spark, sf_dir):
    """M3 with MLlib KMeans (8 clusters, seed 1234): rows only, centroids depend on the solver."""
    pu = embedding_pu(spark, sf_dir)
    return KMeansDetector(0.3, 8).detect(pu, "vec_id").select("vec_id", "role")


@register(
    "move_tails",
    f"""
WITH {EMB},
d AS (SELECT a.vec_id, b.vec_id AS nn, b.y_pu, list_distance(a.v, b.v) AS dist FROM e a, e b),
r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY round(dist, 9), nn) AS rk FROM d),
c AS (SELECT vec_id, round(avg(y_pu), 9) AS s FROM r
      WHERE rk <= 5 AND vec_id IN (SELECT vec_id FROM e WHERE y_pu = 0) GROUP BY vec_id),
o AS (SELECT vec_id, row_number() OVER (ORDER BY s, vec_id) AS lo, row_number() OVER (ORDER BY s DESC, vec_id) AS hi,
             floor(count(*) OVER () * 0.05) AS m FROM c)
SELECT vec_id, CASE WHEN lo <= m THEN 'N' WHEN hi <= m THEN 'P' ELSE 'U' END AS role FROM o
""",
)
def q_move_tails(spark, sf_dir):
    """T2 (one two-step move): 5 % lowest credibility to N, 5 % highest to P."""
    pu = embedding_pu(spark, sf_dir)
    cred = credibility(pu, 5, "vec_id").withColumn("s", F.round("credibility", 9))
    t = tail_cuts(cred, "s", "vec_id", 0.05)
    return t.select("vec_id", F.when(F.col("low"), "N").when(F.col("high"), "P").otherwise("U").alias("role"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from . import queries_results  # noqa: F401  (registers more entries)
    from . import queries_models  # noqa: F401
    from . import queries_sources  # noqa: F401

    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    queries()
    return dict(ORACLE)

