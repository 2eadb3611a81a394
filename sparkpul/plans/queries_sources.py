"""Registered queries for sources and sinks. CSV inputs are written from the whole
benchmark table to a fresh folder under the shared checkpoint folder, then read."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions.columns import greater
from ..session import scratch_path
from ..sources import tables as SRC
from .queries import register, r6
from .tables import table

IMG_ROOT = "/data/img"
EVENTS_CSV_SCHEMA = "event_id long, event_type string, value double, path string"


def _events_csv(spark, sf_dir) -> str:
    ev = table(spark, sf_dir, "events")
    path = scratch_path(spark, "events-csv")
    ev.select(
        "event_id",
        "event_type",
        "value",
        F.concat("event_type", F.lit("/"), F.col("event_id").cast("string"), F.lit(".jpg")).alias("path"),
    ).write.option("header", True).csv(path)
    return path


EV_PATH = "'/data/img/' || event_type || '/' || event_id || '.jpg'"


@register("csv_paths", f"SELECT {EV_PATH} AS path FROM events")
def q_csv_paths(spark, sf_dir):
    """S1 + F1: CSV -> rooted path column."""
    df = SRC.read_scored_csv(spark, _events_csv(spark, sf_dir), EVENTS_CSV_SCHEMA, "path", IMG_ROOT)
    return SRC.load_paths(df, "path")


@register("csv_full_table", f"SELECT event_id, event_type, round(value, 6) AS value, {EV_PATH} AS path FROM events")
def q_csv_full_table(spark, sf_dir):
    """CSV -> full table with the path column rooted."""
    df = SRC.read_scored_csv(spark, _events_csv(spark, sf_dir), EVENTS_CSV_SCHEMA, "path", IMG_ROOT)
    return df.select("event_id", "event_type", r6("value").alias("value"), "path")


@register(
    "csv_positive_unlabeled",
    f"SELECT {EV_PATH} AS path, (coalesce(value > 100 AND NOT isnan(value), false))::INTEGER AS y_pu FROM events",
)
def q_csv_positive_unlabeled(spark, sf_dir):
    """S3: paths split into positive / unlabeled by a predicate."""
    df = SRC.read_scored_csv(spark, _events_csv(spark, sf_dir), EVENTS_CSV_SCHEMA, "path", IMG_ROOT)
    return SRC.positive_unlabeled_paths(df, "path", greater("value", 100.0))


@register(
    "csv_pu_with_test",
    f"""WITH ev AS (SELECT *, {EV_PATH} AS path,
             (coalesce(value >= 50 AND NOT isnan(value), false))::INTEGER AS y_true,
             (coalesce(value > 100 AND NOT isnan(value), false))::INTEGER AS y_pu FROM events),
r AS (SELECT *, row_number() OVER (PARTITION BY y_true ORDER BY md5('1234:' || event_id), event_id) AS rk,
             floor(count(*) OVER (PARTITION BY y_true) * 0.3) AS amt FROM ev)
SELECT event_id, path, CASE WHEN rk <= amt THEN 'test' ELSE 'train' END AS split, y_pu, y_true FROM r""",
)
def q_csv_pu_with_test(spark, sf_dir):
    """PU train paths plus a PN test set (30 %)."""
    df = SRC.read_scored_csv(spark, _events_csv(spark, sf_dir), EVENTS_CSV_SCHEMA, "path", IMG_ROOT)
    return SRC.pu_with_test(df, "event_id", "path", greater("value", 100.0), greater("value", 50.0, inclusive=True), 0.3)


@register(
    "csv_pn_with_test",
    f"""WITH ev AS (SELECT *, {EV_PATH} AS path,
             (coalesce(value >= 50 AND NOT isnan(value), false))::INTEGER AS y_true FROM events),
r AS (SELECT *, row_number() OVER (PARTITION BY y_true ORDER BY md5('1234:' || event_id), event_id) AS rk,
             floor(count(*) OVER (PARTITION BY y_true) * 0.3) AS amt FROM ev)
SELECT event_id, path, CASE WHEN rk <= amt THEN 'test' ELSE 'train' END AS split, y_true FROM r""",
)
def q_csv_pn_with_test(spark, sf_dir):
    """PN train and test paths by one predicate."""
    df = SRC.read_scored_csv(spark, _events_csv(spark, sf_dir), EVENTS_CSV_SCHEMA, "path", IMG_ROOT)
    return SRC.pn_with_test(df, "event_id", "path", greater("value", 50.0, inclusive=True), 0.3)


def _text_features(batch):
    """Stand-in model for S7: 7 character-class shares and the log length of the whole text."""
    s = batch.fillna("")
    n = s.str.len().clip(lower=1).astype(float)
    shares = [
        s.str.count(r"[aeiouAEIOU]"),
        s.str.count(" "),
        s.str.count(r"[0-9]"),
        s.str.count(r"[A-Z]"),
        s.str.count(r"[.,;:!?]"),
        s.str.count("\n"),
        s.str.count(r"[^\x00-\x7f]"),
    ]
    cols = [c.astype(float) / n for c in shares] + [np.log1p(s.str.len().astype(float))]
    return np.stack([c.to_numpy() for c in cols], axis=1)


def _feature_sql() -> str:
    t = "coalesce(text, '')"
    n = f"greatest(1, length({t}))"

    def count(pattern: str) -> str:
        return f"(length({t}) - length(regexp_replace({t}, '{pattern}', '', 'g')))"

    shares = [count("[aeiouAEIOU]"), count(" "), count("[0-9]"), count("[A-Z]"), count("[.,;:!?]"),
              count("\n"), count("[^\x00-\x7f]")]
    cols = [f"round({c} / {n}, 6) AS f{i}" for i, c in enumerate(shares)]
    cols.append(f"round(ln(1 + length({t})), 6) AS f7")
    return "SELECT doc_id, lang, " + ", ".join(cols) + " FROM documents"


@register("feature_store", _feature_sql())
def q_feature_store(spark, sf_dir):
    """S6 + S7 + J1: document features from a store; the second request computes
    only the ids the first one did not cover. Features use the whole text."""
    docs = table(spark, sf_dir, "documents")
    store = scratch_path(spark, "feature-store")
    extract = SRC.batch_extractor(_text_features, 8)
    english = docs.where("lang = 'en'")
    SRC.feature_store(english, "doc_id", "text", store, "bench", "charclass", extract)
    feats = SRC.feature_store(docs, "doc_id", "text", store, "bench", "charclass", extract)
    out = SRC.attach_features(docs.select("doc_id", "lang"), feats, "doc_id")
    return out.select("doc_id", "lang", *[r6(F.col("features")[i]).alias(f"f{i}") for i in range(8)])


@register(
    "quarantine_pages",
    """SELECT page_id, (html LIKE '<!DOCTYPE html>%' AND html LIKE '%</html>%') AS valid FROM pages""",
)
def q_quarantine_pages(spark, sf_dir):
    """Pages whose payload is a complete HTML document vs the rest."""
    pages = table(spark, sf_dir, "pages")
    ok = F.col("html").startswith("<!DOCTYPE html>") & F.col("html").contains("</html>")
    # one scan of the payload: the flag is what separates the two sides
    return SRC.validity(pages, ok).select("page_id", "valid")


RESULT_SCHEMA = "classifier string, dataset string, metric double, n long"


@register(
    "result_files",
    """SELECT o_orderstatus AS setting, o_orderpriority AS classifier, CAST(year(o_orderdate) AS VARCHAR) AS dataset,
       round(avg(o_totalprice), 6) AS metric, count(*)::BIGINT AS n FROM orders GROUP BY 1, 2, 3""",
)
def q_result_files(spark, sf_dir):
    """S9 + S10 + S12: result files per setting are written by one job, a second write of a
    finished table is skipped, and they are read back, tagged and stacked."""
    o = table(spark, sf_dir, "orders")
    path = scratch_path(spark, "results")
    res = o.groupBy(
        F.col("o_orderstatus").alias("setting"), F.col("o_orderpriority").alias("classifier"),
        F.year("o_orderdate").cast("string").alias("dataset"),
    ).agg(F.avg("o_totalprice").alias("metric"), F.count(F.lit(1)).alias("n"))
    SRC.write_results(res, path, keys=["setting"], fmt="csv")
    SRC.write_results(res.limit(0), path, fmt="csv", skip_existing=True)
    out = spark.read.schema(RESULT_SCHEMA + ", setting string").option("header", True).csv(path)
    return out.select("setting", "classifier", "dataset", r6("metric").alias("metric"), "n")


@register(
    "result_cell_overwrite",
    """WITH r AS (SELECT o_orderstatus AS cell, o_orderpriority AS classifier, avg(o_totalprice) AS metric FROM orders GROUP BY 1, 2)
SELECT cell, classifier, round(CASE WHEN cell = 'F' THEN -metric ELSE metric END, 6) AS metric FROM r""",
)
def q_result_cell_overwrite(spark, sf_dir):
    """Writing one cell again replaces that cell and leaves the others."""
    o = table(spark, sf_dir, "orders")
    path = scratch_path(spark, "result-cells")
    res = o.groupBy(F.col("o_orderstatus").alias("cell"), F.col("o_orderpriority").alias("classifier")).agg(
        F.avg("o_totalprice").alias("metric")
    )
    SRC.write_results(res, path, keys=["cell"])
    again = res.where("cell = 'F'").withColumn("metric", -F.col("metric"))
    SRC.write_results(again, path, keys=["cell"])
    out = spark.read.parquet(path)
    return out.select(F.col("cell").cast("string").alias("cell"), "classifier", r6("metric").alias("metric"))


@register(
    "result_lists",
    """SELECT l_orderkey, count(*)::BIGINT AS n, round(sum(l_discount), 6) AS total FROM lineitem GROUP BY 1""",
)
def q_result_lists(spark, sf_dir):
    """S9 list columns: result rows with a list of predictions are written as CSV text and
    read back as lists."""
    li = table(spark, sf_dir, "lineitem")
    path = scratch_path(spark, "result-lists")
    # a stored row holds at most 1,000 entries, so a hot order becomes several rows
    rows = li.groupBy("l_orderkey", F.floor(F.col("l_linenumber") / 1000).alias("chunk")).agg(
        F.collect_list("l_discount").alias("y_pred")
    )
    SRC.write_results(rows, path, fmt="csv")
    back = spark.read.schema("l_orderkey long, chunk long, y_pred string").option("header", True).option("escape", '"').csv(path)
    lists = back.select("l_orderkey", C.parse_list("y_pred").alias("p"))
    return lists.groupBy("l_orderkey").agg(
        F.sum(F.size("p")).cast("long").alias("n"),
        r6(F.sum(F.aggregate("p", F.lit(0.0), lambda a, x: a + x))).alias("total"),
    )


PROJ_DIM, PROJ_OUT, PROJ_SEED = 64, 8, 1234


def projection_weights():
    """The stand-in model of S7: a fixed, seeded 64 x 8 projection."""
    return np.random.default_rng(PROJ_SEED).normal(size=(PROJ_DIM, PROJ_OUT)) / np.sqrt(PROJ_DIM)


def _projection_sql() -> str:
    w = projection_weights()
    cols = []
    for j in range(PROJ_OUT):
        lit = "[" + ", ".join(repr(float(x)) for x in w[:, j]) + "]::DOUBLE[]"
        cols.append(f"round(list_dot_product(embedding::DOUBLE[], {lit}), 6) AS f{j}")
    return "SELECT vec_id, " + ", ".join(cols) + " FROM embeddings"


@register("projected_features", _projection_sql())
def q_projected_features(spark, sf_dir):
    """Batched model inference (``predict_batch_udf``, 900 rows a call) over every
    feature vector; the model is a fixed numpy projection."""
    e = table(spark, sf_dir, "embeddings")
    weights = projection_weights()

    def make_fn():
        w = weights

        def predict(x):
            return x.astype(np.float64) @ w

        return predict

    extract = SRC.tensor_extractor(make_fn, PROJ_DIM)
    out = e.select("vec_id", extract(F.col("embedding").cast("array<double>")).alias("f"))
    return out.select("vec_id", *[r6(F.col("f")[j]).alias(f"f{j}") for j in range(PROJ_OUT)])
