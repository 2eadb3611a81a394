"""Registered queries for base classifiers, PU algorithms and experiment grids.

The feature table is ``embeddings``: known positive ``label < 3``, true positive
``label < 5``. A stratified 25 % of each true class is the test set; 20 % of the
rest, stratified by the PU label, is the validation set.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import splits as S
from ..operators.detectors import KMeansDetector, KNNDetector, RandomDetector
from ..session import scratch_path
from . import grid as G
from .base import Fitted, GaussianNB, make_classifier
from .models import NonNegativePU, NonStop, ProbTagging, StopOnMetricDrop, TwoStep
from .parallel import run_parallel
from .queries import register, r6
from .tables import embedding_pu


def pu_splits(spark, sf_dir):
    pu = embedding_pu(spark, sf_dir)
    sp = S.stratified_split(pu, "vec_id", "y_true", 0.25)
    test = sp.where("split = 'val'").drop("split")
    rest = sp.where("split = 'train'").drop("split")
    tv = S.stratified_split(rest, "vec_id", "y_pu", 0.2)
    return tv.where("split = 'train'").drop("split"), tv.where("split = 'val'").drop("split"), test


def _scored(model, test):
    # the label follows from the probability where the model says how: test rows are scored once
    p = model.predict_proba(test, out="prob")
    if isinstance(getattr(model, "model", model), Fitted) and not isinstance(model, ProbTagging):
        p = p.withColumn("prediction", (F.col("prob") > getattr(model, "model", model).threshold).cast("int"))
    else:
        p = model.predict(p, out="prediction")
    return p.select("vec_id", "y_true", F.round("prob", 6).alias("prob"), F.col("prediction").cast("int"))


NB_SQL = """
WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v, CASE WHEN coalesce(label < 5, false) THEN 1 ELSE 0 END AS y FROM embeddings),
h AS (SELECT *, row_number() OVER (PARTITION BY y ORDER BY md5('1234:' || vec_id), vec_id) AS rk,
             floor(count(*) OVER (PARTITION BY y) * 0.25) AS amt FROM e),
tr AS (SELECT * FROM h WHERE rk > amt), te AS (SELECT * FROM h WHERE rk <= amt),
ex AS (SELECT y AS c, unnest(v) AS x, unnest(range(len(v))) AS i FROM tr),
mom AS (SELECT c, i, avg(x) AS m, var_pop(x) AS s FROM ex GROUP BY c, i),
eps AS (SELECT 1e-9 * max(vv) AS eps FROM (SELECT i, var_pop(x) AS vv FROM ex GROUP BY i)),
pri AS (SELECT y AS c, count(*) / (SELECT count(*) FROM tr) AS p FROM tr GROUP BY y),
tx AS (SELECT vec_id, unnest(v) AS x, unnest(range(len(v))) AS i FROM te),
jll AS (SELECT tx.vec_id, mom.c, sum(-0.5 * ln(2 * pi() * (mom.s + eps.eps)) - (tx.x - mom.m) * (tx.x - mom.m) / (2 * (mom.s + eps.eps))) AS ll
        FROM tx JOIN mom ON tx.i = mom.i CROSS JOIN eps GROUP BY tx.vec_id, mom.c),
j2 AS (SELECT jll.vec_id, jll.c, jll.ll + ln(pri.p) AS ll FROM jll JOIN pri ON jll.c = pri.c),
pr AS (SELECT vec_id, 1 / (1 + exp(max(ll) FILTER (WHERE c = 0) - max(ll) FILTER (WHERE c = 1))) AS prob FROM j2 GROUP BY vec_id)
SELECT vec_id, round(prob, 6) AS prob, (prob > 0.5)::INTEGER AS prediction FROM pr
"""


@register("naive_bayes", NB_SQL)
def q_naive_bayes(spark, sf_dir):
    """Gaussian naive Bayes from class moments (PN on the true label), test rows."""
    pu = embedding_pu(spark, sf_dir)
    sp = S.stratified_split(pu, "vec_id", "y_true", 0.25)
    model = GaussianNB().fit(sp.where("split = 'train'"), "y_true")
    test = sp.where("split = 'val'")
    out = model.predict(model.predict_proba(test, out="prob"), out="prediction")
    return out.select("vec_id", r6("prob").alias("prob"), F.col("prediction").cast("int"))


def _pn(name):
    def q(spark, sf_dir):
        pu = embedding_pu(spark, sf_dir)
        sp = S.stratified_split(pu, "vec_id", "y_true", 0.25)
        model = make_classifier(name).fit(sp.where("split = 'train'"), "y_true")
        return _scored(model, sp.where("split = 'val'"))

    q.__doc__ = f"PN classifier '{name}' on the true label, scored on the test rows."
    return q


def _inverse_sql(name: str, gram: str) -> str:
    """Inverses of the matrices ``gram`` (g, i, j, h) as table ``name`` (g, inv), a list of
    rows each, by Gauss-Jordan elimination with one recursion step per pivot."""
    return f"""{name}_a AS (SELECT g, i, list(h ORDER BY j) AS a FROM {gram} GROUP BY g, i),
{name}_r AS (
  SELECT 1 AS k, g, list(a || list_transform(a, lambda x, j: (j = i)::INTEGER::DOUBLE) ORDER BY i) AS m FROM {name}_a GROUP BY g
  UNION ALL
  SELECT k + 1, g, list_transform(m, lambda r, i: CASE WHEN i = k THEN p ELSE list_transform(r, lambda x, j: x - r[k] * p[j]) END)
  FROM (SELECT k, g, m, list_transform(m[k], lambda x: x / m[k][k]) AS p FROM {name}_r WHERE k <= len(m))),
{name} AS (SELECT g, list_transform(m, lambda r: r[len(m) + 1:]) AS inv FROM {name}_r WHERE k = len(m) + 1)"""


def _fixed_newton_sql(name: str, source: str, slope: str, bound: float, free: bool, steps: int, shared: bool = False) -> str:
    """Weights of linear models as table ``name`` (g, w): ``steps`` Newton steps with the
    greatest curvature the loss can have, which go down to the same optimum.

    ``source`` has g, va (features and a 1) and y; ``slope`` is the loss's slope in ``z``;
    ``free`` leaves the last weight without penalty; ``shared``: all g have the same rows.
    """
    pen = "(i < len(va))::INTEGER" if free else "1"
    key = "(SELECT min(g) FROM " + source + ")"
    only = f"WHERE g = {key}" if shared else ""
    match = "" if shared else "AND v.g = o.g"
    return f"""{name}_n AS (SELECT row_number() OVER () AS n, * FROM {source}),
{name}_x AS (SELECT g, n, unnest(va) AS x, unnest(range(1, len(va) + 1)) AS i, len(va) AS d FROM {name}_n {only}),
{name}_h AS (SELECT a.g, a.i, b.i AS j, {bound} * sum(a.x * b.x) + (a.i = b.i AND {'a.i < any_value(a.d)' if free else 'true'})::INTEGER AS h
             FROM {name}_x a JOIN {name}_x b USING (n) GROUP BY a.g, a.i, b.i),
{_inverse_sql(name + "_i", name + "_h")},
{name}_w AS (
  SELECT 0 AS it, g, list_transform(any_value(va), lambda x: 0.0::DOUBLE) AS w FROM {source} GROUP BY g
  UNION ALL
  SELECT it + 1, o.g, list_transform(w, lambda x, i: x - list_dot_product(inv[i], grad))
  FROM (SELECT it, g, any_value(w) AS w, list(s ORDER BY i) AS grad
        FROM (SELECT it, g, i, any_value(w) AS w, sum(r * x) + any_value({pen} * w[i]) AS s
              FROM (SELECT it, g, w, va, {slope} AS r, unnest(va) AS x, unnest(range(1, len(va) + 1)) AS i
                    FROM (SELECT it, f.g, w, va, y, list_dot_product(w, va) AS z FROM {name}_w JOIN {name}_n f USING (g) WHERE it < {steps}))
              GROUP BY it, g, i) GROUP BY it, g) o JOIN {name}_i v ON true {match}),
{name} AS (SELECT g, w FROM {name}_w WHERE it = {steps})"""


LOGISTIC_SLOPE = "1 / (1 + exp(-z)) - y"
HINGE_SLOPE = "-2 * (2 * y - 1) * greatest(0, 1 - (2 * y - 1) * z)"

# train and test rows of the PN queries
PN_SQL = """e AS (SELECT vec_id, list_append(embedding::DOUBLE[], 1.0) AS va, coalesce(label < 5, false)::INTEGER AS y FROM embeddings),
h AS (SELECT *, row_number() OVER (PARTITION BY y ORDER BY md5('1234:' || vec_id), vec_id) AS rk,
             floor(count(*) OVER (PARTITION BY y) * 0.25) AS amt FROM e),
tr AS (SELECT * FROM h WHERE rk > amt), te AS (SELECT * FROM h WHERE rk <= amt)"""

register(
    "logistic_regression",
    f"""WITH RECURSIVE {PN_SQL}, f AS (SELECT 0 AS g, va, y FROM tr),
{_fixed_newton_sql("l", "f", LOGISTIC_SLOPE, 0.25, True, 60)},
s AS (SELECT vec_id, y, 1 / (1 + exp(-list_dot_product(w, va))) AS prob FROM te, l)
SELECT vec_id, y AS y_true, round(prob, 6) AS prob, (prob > 0.5)::INTEGER AS prediction FROM s""",
)(_pn("logistic"))  # M11
register("random_forest")(_pn("rf"))  # M14
register(
    "calibrated_svm",
    f"""WITH RECURSIVE {PN_SQL},
fo AS (SELECT vec_id, va, y, floor((row_number() OVER (PARTITION BY y ORDER BY md5('1234:' || vec_id), vec_id) - 1) * 5
              / count(*) OVER (PARTITION BY y))::INTEGER AS fold FROM tr),
f AS (SELECT g, va, y FROM fo, unnest(range(5)) AS t(g) WHERE fold <> g),
{_fixed_newton_sql("s", "f", HINGE_SLOPE, 2.0, False, 80)},
held AS (SELECT fold AS g, list_dot_product(w, va) AS m, y, sum(y) OVER (PARTITION BY fold) AS n1, sum(1 - y) OVER (PARTITION BY fold) AS n0
         FROM fo JOIN s ON s.g = fold),
soft AS (SELECT g, m, CASE WHEN y = 1 THEN (n1 + 1) / (n1 + 2) ELSE 1 / (n0 + 2) END AS t FROM held),
pl AS (
  SELECT 0 AS it, g, 0.0::DOUBLE AS a, 0.0::DOUBLE AS b FROM s
  UNION ALL
  SELECT it + 1, g, a - (hbb * ga - hab * gb) / (haa * hbb - hab * hab), b - (haa * gb - hab * ga) / (haa * hbb - hab * hab)
  FROM (SELECT it, g, a, b, sum((p - t) * m) AS ga, sum(p - t) AS gb, sum(p * (1 - p) * m * m) AS haa, sum(p * (1 - p) * m) AS hab,
               sum(p * (1 - p)) AS hbb
        FROM (SELECT it, soft.g, a, b, m, t, 1 / (1 + exp(-(a * m + b))) AS p FROM pl JOIN soft USING (g) WHERE it < 30)
        GROUP BY it, g, a, b)),
sc AS (SELECT vec_id, any_value(y) AS y, avg(1 / (1 + exp(-(a * list_dot_product(w, va) + b)))) AS prob
       FROM te, s JOIN pl USING (g) WHERE it = 30 GROUP BY vec_id)
SELECT vec_id, y AS y_true, round(prob, 6) AS prob, (prob > 0.5)::INTEGER AS prediction FROM sc""",
)(_pn("svm"))  # M15


@register("two_step")
def q_two_step(spark, sf_dir):
    """M4 + M5: two-step with kNN negatives (k 5, 10 %), logistic base, 5 % moved per
    round, stop on AUL drop, at most 20 rounds; test predictions."""
    train, val, test = pu_splits(spark, sf_dir)
    algo = TwoStep(KNNDetector(0.1, 5), StopOnMetricDrop("aul"), make_classifier("logistic"),
                   frac_to_move=0.05, max_iterations=20).fit(train, val)
    return _scored(algo, test)


@register("two_step_nonstop_kmeans")
def q_two_step_nonstop(spark, sf_dir):
    """M4 + M6 + M3: two-step with k-means negatives and naive Bayes, 20 rounds without a stop."""
    train, val, test = pu_splits(spark, sf_dir)
    algo = TwoStep(KMeansDetector(0.2, 6), NonStop("accuracy"), make_classifier("naivebayes"),
                   frac_to_move=0.05, max_iterations=20).fit(train, val)
    return _scored(algo, test)


# The splits of pu_splits as DuckDB tables: te (test), va (validation), tr (train).
SPLITS_SQL = """e AS (SELECT vec_id, embedding::DOUBLE[] AS v, coalesce(label < 3, false)::INTEGER AS y_pu,
              coalesce(label < 5, false)::INTEGER AS y_true FROM embeddings),
s1 AS (SELECT *, row_number() OVER (PARTITION BY y_true ORDER BY md5('1234:' || vec_id), vec_id)
              <= floor(count(*) OVER (PARTITION BY y_true) * 0.25) AS is_test FROM e),
te AS (SELECT * FROM s1 WHERE is_test),
s2 AS (SELECT *, row_number() OVER (PARTITION BY y_pu ORDER BY md5('1234:' || vec_id), vec_id)
              <= floor(count(*) OVER (PARTITION BY y_pu) * 0.2) AS is_val FROM s1 WHERE NOT is_test),
va AS (SELECT * FROM s2 WHERE is_val), tr AS (SELECT * FROM s2 WHERE NOT is_val)"""


def _nb_sql(name: str, source: str, group: str = "0") -> str:
    """Naive Bayes moments of ``source`` (columns v, c) per ``group`` as tables name_m, name_e, name_p."""
    return f"""{name}_x AS (SELECT {group} AS g, c, unnest(v) AS x, unnest(range(len(v))) AS i FROM {source}),
{name}_m AS (SELECT g, c, i, avg(x) AS m, var_pop(x) AS s FROM {name}_x GROUP BY g, c, i),
{name}_e AS (SELECT g, 1e-9 * max(vv) AS eps FROM (SELECT g, i, var_pop(x) AS vv FROM {name}_x GROUP BY g, i) GROUP BY g),
{name}_p AS (SELECT g, c, n / sum(n) OVER (PARTITION BY g) AS p
             FROM (SELECT {group} AS g, c, count(*) AS n FROM {source} GROUP BY ALL))"""


def _nb_score_sql(name: str, source: str, out: str) -> str:
    """Probability of class 1 of every row of ``source`` by the moments of ``name``, per group."""
    return f"""{out}_x AS (SELECT vec_id, unnest(v) AS x, unnest(range(len(v))) AS i FROM {source}),
{out}_l AS (SELECT t.vec_id, m.g, m.c, sum(-0.5 * ln(2 * pi() * (m.s + eps)) - (t.x - m.m) * (t.x - m.m) / (2 * (m.s + eps))) AS ll
            FROM {out}_x t JOIN {name}_m m USING (i) JOIN {name}_e USING (g) GROUP BY ALL),
{out} AS (SELECT vec_id, g, 1 / (1 + exp(max(ll + ln(p)) FILTER (WHERE c = 0) - max(ll + ln(p)) FILTER (WHERE c = 1))) AS prob
          FROM {out}_l JOIN {name}_p USING (g, c) GROUP BY vec_id, g)"""


@register(
    "two_step_naive_bayes",
    f"""WITH {SPLITS_SQL},
u0 AS (SELECT vec_id FROM (SELECT vec_id, row_number() OVER (ORDER BY md5('1234:' || vec_id), vec_id) AS r, count(*) OVER () AS n
       FROM tr WHERE y_pu = 0) WHERE r <= floor(n * 0.3)),
r0 AS (SELECT *, CASE WHEN y_pu = 1 THEN 'P' WHEN vec_id IN (FROM u0) THEN 'N' ELSE 'U' END AS role FROM tr),
f0 AS (SELECT v, (role = 'P')::INTEGER AS c FROM r0 WHERE role <> 'U'), {_nb_sql("a", "f0")},
w0 AS (SELECT vec_id, v FROM r0 WHERE role = 'U'), {_nb_score_sql("a", "w0", "q0")},
k0 AS (SELECT vec_id, row_number() OVER (ORDER BY round(prob, 12), vec_id) AS lo,
              row_number() OVER (ORDER BY round(prob, 12) DESC, vec_id) AS hi, floor(count(*) OVER () * 0.05) AS m FROM q0),
r1 AS (SELECT r0.* EXCLUDE (role), CASE WHEN lo <= m THEN 'N' WHEN hi <= m THEN 'P' ELSE role END AS role
       FROM r0 LEFT JOIN k0 USING (vec_id)),
f1 AS (SELECT v, (role = 'P')::INTEGER AS c FROM r1 WHERE role <> 'U'), {_nb_sql("b", "f1")},
{_nb_score_sql("b", "te", "q1")}
SELECT vec_id, te.y_true, round(prob, 6) AS prob, (prob > 0.5)::INTEGER AS prediction FROM q1 JOIN te USING (vec_id)""",
)
def q_two_step_naive_bayes(spark, sf_dir):
    """M4 + M6 + X2-X4: two rounds of two-step with random negatives and naive Bayes."""
    train, val, test = pu_splits(spark, sf_dir)
    algo = TwoStep(RandomDetector(0.3), NonStop("accuracy"), make_classifier("naivebayes"),
                   frac_to_move=0.05, max_iterations=2).fit(train, val)
    return _scored(algo, test)


@register(
    "prob_tagging_naive_bayes",
    f"""WITH {SPLITS_SQL},
d AS (SELECT a.vec_id, b.vec_id AS nn, b.y_pu, list_distance(a.v, b.v) AS dist FROM tr a, tr b WHERE a.y_pu = 0),
k AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY round(dist, 9), nn) AS rk FROM d),
cr AS (SELECT vec_id, avg(y_pu) AS cred FROM k WHERE rk <= 9 GROUP BY vec_id),
cp AS (SELECT vec_id, cred, unnest(range(0, 4)) AS copy FROM cr),
tg AS (SELECT vec_id, copy, ((('0x' || substr(md5('1234:' || vec_id || ':' || copy), 1, 13))::BIGINT::DOUBLE / 4503599627370496.0)
              < cred)::INTEGER AS c FROM cp),
f AS (SELECT tr.v, tg.c, tg.copy FROM tg JOIN tr USING (vec_id)), {_nb_sql("a", "f", "copy")},
{_nb_score_sql("a", "te", "q")},
pr AS (SELECT avg(y_pu) AS prior FROM tr)
SELECT vec_id, any_value(te.y_true) AS y_true, round(avg(prob), 6) AS prob,
       (avg((prob > 0.5)::INTEGER) > any_value(prior))::INTEGER AS prediction
FROM q JOIN te USING (vec_id), pr GROUP BY vec_id""",
)
def q_prob_tagging_naive_bayes(spark, sf_dir):
    """M7 + A13 + X6: ProbTagging with 9-NN credibility and 4 naive Bayes members."""
    train, _, test = pu_splits(spark, sf_dir)
    algo = ProbTagging(9, lambda: make_classifier("naivebayes"), 4).fit(train)
    return _scored(algo, test)


@register(
    "prob_tagging",
    f"""WITH RECURSIVE {SPLITS_SQL},
d AS (SELECT a.vec_id, b.vec_id AS nn, b.y_pu, list_distance(a.v, b.v) AS dist FROM tr a, tr b WHERE a.y_pu = 0),
k AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY round(dist, 9), nn) AS rk FROM d),
cr AS (SELECT vec_id, avg(y_pu) AS cred FROM k WHERE rk <= 9 GROUP BY vec_id),
cp AS (SELECT vec_id, cred, unnest(range(0, 50)) AS copy FROM cr),
f AS (SELECT copy AS g, list_append(tr.v, 1.0) AS va,
             ((('0x' || substr(md5('1234:' || vec_id || ':' || copy), 1, 13))::BIGINT::DOUBLE / 4503599627370496.0) < cred)::INTEGER AS y
      FROM cp JOIN tr USING (vec_id) ORDER BY copy, vec_id),
{_fixed_newton_sql("l", "f", LOGISTIC_SLOPE, 0.25, True, 80, shared=True)},
q AS (SELECT vec_id, y_true, list_dot_product(w, list_append(v, 1.0)) AS z FROM te, l),
pr AS (SELECT avg(y_pu) AS prior FROM tr)
SELECT vec_id, any_value(y_true) AS y_true, round(avg(1 / (1 + exp(-z))), 6) AS prob,
       (avg((z > 0)::INTEGER) > any_value(prior))::INTEGER AS prediction
FROM q, pr GROUP BY vec_id""",
)
def q_prob_tagging(spark, sf_dir):
    """M7: ProbTagging with 9-NN credibility and the 50 logistic members of the experiments."""
    train, _, test = pu_splits(spark, sf_dir)
    algo = ProbTagging(9, lambda: make_classifier("logistic"), 50).fit(train)
    return _scored(algo, test)


PN_GRID_SQL = f"""WITH {SPLITS_SQL},
f AS (SELECT v, y_true AS c FROM s2), {_nb_sql("a", "f")}, {_nb_score_sql("a", "te", "q")},
nb AS (SELECT vec_id, (prob > 0.5)::INTEGER AS p FROM q),
d AS (SELECT t.vec_id, r.y_true AS y, row_number() OVER (PARTITION BY t.vec_id ORDER BY round(list_distance(t.v, r.v), 9), r.vec_id) AS rk
      FROM te t, s2 r),
kn AS (SELECT vec_id, (avg(y) > 0.5)::INTEGER AS p FROM d WHERE rk <= 5 GROUP BY vec_id),
al AS (SELECT 'naivebayes' AS classifier, * FROM nb UNION ALL SELECT 'kneighbours-5', * FROM kn),
c AS (SELECT classifier, sum(p * y_true) AS tp, sum(p * (1 - y_true)) AS fp, sum((1 - p) * y_true) AS fn,
             sum((1 - p) * (1 - y_true)) AS tn FROM al JOIN te USING (vec_id) GROUP BY classifier)
SELECT classifier, round((tp / (tp + fn) + tn / (tn + fp)) / 2, 6) AS balanced_accuracy,
       round((tp + tn) / (tp + fp + fn + tn), 6) AS accuracy, round(2 * tp / (2 * tp + fp + fn), 6) AS f1 FROM c"""


@register("pn_baseline_grid", PN_GRID_SQL)
def q_pn_baseline_grid(spark, sf_dir):
    """M16 by the grid runner: naive Bayes and 5-NN on the true labels, scored on the test rows."""
    settings = [G.Setting("embeddings", lambda: pu_splits(spark, sf_dir), "embeddings", 3.0)]
    out = G.pn_baselines(spark, settings, ["naivebayes", "kneighbours-5"])
    return out.select("classifier", *[r6(c).alias(c) for c in ("balanced_accuracy", "accuracy", "f1")])


@register("shared_grid", PN_GRID_SQL)
def q_shared_grid(spark, sf_dir):
    """S10 + S11 + J8: the same cells filled by two sessions that share a path and a ledger."""
    path = scratch_path(spark, "shared-grid")
    cells = G.cross(setting=["embeddings"], classifier=["naivebayes", "kneighbours-5"])

    def fill(session):
        settings = [G.Setting("embeddings", lambda: pu_splits(session, sf_dir), "embeddings", 3.0)]
        return G.run_shared_grid(session, settings, cells, lambda c: G.Supervised(make_classifier(c["classifier"])), path)

    out = run_parallel([spark, spark.newSession()], fill)[0]
    return out.select("classifier", *[r6(c).alias(c) for c in ("balanced_accuracy", "accuracy", "f1")])


@register("nnpu")
def q_nnpu(spark, sf_dir):
    """M8: non-negative PU, linear-sigmoid model, prior 0.5, the published 200 epochs."""
    train, _, test = pu_splits(spark, sf_dir)
    algo = NonNegativePU([1], 0.5, batch_rows=G.BATCH_ROWS).fit(train)
    return _scored(algo, test)


@register("nnpu_auto_prior")
def q_nnpu_auto(spark, sf_dir):
    """M9: nnPU with the prior re-estimated on validation rows every epoch."""
    train, val, test = pu_splits(spark, sf_dir)
    algo = NonNegativePU([1], "auto", batch_rows=G.BATCH_ROWS).fit(train, val)
    return _scored(algo, test)


@register("nnpu_mlp")
def q_nnpu_mlp(spark, sf_dir):
    """nnPU with one hidden layer of 16 ReLU units."""
    train, _, test = pu_splits(spark, sf_dir)
    algo = NonNegativePU([16, 1], 0.5, batch_rows=G.BATCH_ROWS).fit(train)
    return _scored(algo, test)


@register("pn_baselines")
def q_pn_baselines(spark, sf_dir):
    """The seven published PN baselines on two settings of the feature table."""
    settings = [G.Setting(f"seed-{seed}", lambda seed=seed: G.feature_splits(spark, sf_dir, 3, seed)) for seed in (1234, 7)]
    return G.pn_baselines(spark, settings)


@register("experiment_grid")
def q_experiment_grid(spark, sf_dir):
    """M17 + J12: thresholds x classifiers x detectors, one two-step run of the published 20
    rounds at 1 % per cell."""
    return G.experiment_grid(spark, G.threshold_settings(spark, sf_dir, [2, 3]), ["logistic", "naivebayes"],
                             {"knn-5": lambda: KNNDetector(0.1, 5), "random": lambda: RandomDetector(0.1)})


@register("algorithm_comparison")
def q_algorithm_comparison(spark, sf_dir):
    """M18 + J13: two-step, nnPU and ProbTagging over threshold and positive-class axes that
    walk in lock-step, at the published rounds, epochs and members."""
    settings = [
        G.Setting(f"t{c['t']}-p{c['p']}", lambda c=c: G.feature_splits(spark, sf_dir, c["t"], positive_below=c["p"]), "embeddings", float(c["t"]))
        for c in G.lock_step(t=[2, 3], p=[4, 5])
    ]
    return G.algorithm_comparison(spark, settings, ["tsa", "nnpu", "pt"])


@register("k_selection")
def q_k_selection(spark, sf_dir):
    """M19 + A15: AUL on validation for the five published k over three seeds, pivoted by seed."""
    settings = [G.Setting(str(seed), lambda seed=seed: G.feature_splits(spark, sf_dir, 3, seed)) for seed in (0, 1, 2)]
    return G.k_selection(spark, settings, max_iterations=1, frac_to_move=0.05)


@register("prior_threshold_grid")
def q_prior_threshold_grid(spark, sf_dir):
    """nnPU over prior x threshold."""
    return G.prior_threshold_grid(spark, G.threshold_settings(spark, sf_dir, [2, 3]), [0.3, 0.5, 0.7])


@register("pca_projection")
def q_pca_projection(spark, sf_dir):
    """2-D PCA projection of the embeddings (sign-normalized components)."""
    return G.pca_projection(embedding_pu(spark, sf_dir), "vec_id")
