"""Exact split sizes, disjointness, NaN/null rules (N1-N3) and the split plan."""

import math

import pytest
from pyspark.sql import functions as F

from sparkpul.functions.columns import greater, label
from sparkpul.operators import splits as S


def test_truncation_matches_python_int(spark):
    df = spark.range(100).withColumnRenamed("id", "rid")
    out = S.exact_sample(df, "rid", frac=0.29)
    assert out.where("sampled").count() == int(0.29 * 100) == 28


def test_nan_and_null_scores_go_negative(spark):
    df = spark.createDataFrame([(1, float("nan")), (2, None), (3, 7.0), (4, 3.0)], "id long, score double")
    got = {r["id"]: r["y"] for r in df.select("id", label(greater("score", 5.0)).alias("y")).collect()}
    assert got == {1: 0, 2: 0, 3: 1, 4: 0}


def test_pn_test_split_exact_and_complete(spark):
    ev = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    out = S.pn_test_split(ev, "event_id", greater("value", 100.0), greater("value", 50.0, True), 0.2)
    pdf = out.toPandas()
    assert len(pdf) == ev.count() and pdf["event_id"].is_unique
    for cls, part in pdf.groupby("y_true"):
        assert (part["split"] == "test").sum() == math.floor(0.2 * len(part))


def test_build_pu_plan_and_roles(spark):
    ev = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    out, plan = S.build_pu(ev, "event_id", greater("value", 100.0), greater("value", 50.0, True), 0.2, 0.1,
                           move_frac=0.3, return_plan=True)
    pdf = out.toPandas()
    val = pdf[pdf.split == "val"]
    assert len(val) == plan.val_rows
    assert (val.y_pu == 1).sum() == plan.val_positives
    assert pdf.moved.sum() == plan.hidden_positives
    train = pdf[pdf.split == "train"]
    assert (train.y_pu == 1).sum() == plan.positives - plan.val_positives - plan.hidden_positives


def test_plan_rejects_impossible_share():
    with pytest.raises(ValueError):
        S.plan_sizes(5, 100, 1.0, 0.5, 0.9, 0.0)


def test_bernoulli_tags_reproducible(spark):
    df = spark.createDataFrame([(i, 0.5) for i in range(200)], "id long, p double")
    a = S.bernoulli_tags(df, "id", "p", 3).orderBy("id", "copy").collect()
    b = S.bernoulli_tags(df, "id", "p", 3).orderBy("id", "copy").collect()
    assert a == b
    share = sum(r["tag"] for r in a) / len(a)
    assert 0.4 < share < 0.6


def test_stratified_split_per_class(spark):
    df = spark.range(103).select(F.col("id"), (F.col("id") % 3 == 0).cast("int").alias("y"))
    out = S.stratified_split(df, "id", "y", 0.25).toPandas()
    for cls, part in out.groupby("y"):
        assert (part.split == "val").sum() == math.floor(0.25 * len(part))


def test_dynamic_partition_overwrite_replaces_one_cell(spark):
    """Writing one cell again replaces only that cell; skip keeps a result."""
    from sparkpul.session import scratch_path
    from sparkpul.sources.tables import write_results

    path = scratch_path(spark, "cells")
    a = spark.createDataFrame([("x", 1, 0.1), ("y", 1, 0.2)], "cell string, seed int, v double")
    write_results(a, path, keys=["cell"])
    write_results(spark.createDataFrame([("x", 2, 0.9)], "cell string, seed int, v double"), path, keys=["cell"])
    got = sorted((r["cell"], r["seed"]) for r in spark.read.parquet(path).collect())
    assert got == [("x", 2), ("y", 1)]
    other = scratch_path(spark, "skip")
    write_results(a, other)
    write_results(a.limit(0), other, skip_existing=True)
    assert spark.read.parquet(other).count() == 2


def test_single_table_recipe(spark):
    ev = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    out = S.single_table_recipe(ev, "event_id", "value", 100.0, 50.0).toPandas()
    assert set(out.split) == {"train", "val", "test"}
    assert len(out) == ev.count() and not out.moved.any()


@pytest.mark.parametrize("classes", [7, 2000])
def test_exact_sample_any_number_of_classes(spark, classes):
    df = spark.range(8000).select(F.col("id"), (F.col("id") % classes).alias("c"))
    out = S.exact_sample(df, "id", frac=0.3, by="c").toPandas()
    assert len(out) == 8000
    for _, part in out.groupby("c"):
        assert part.sampled.sum() == math.floor(0.3 * len(part))


def test_exact_sample_null_class_is_a_class(spark):
    df = spark.range(30).select(F.col("id"), F.when(F.col("id") % 3 != 0, F.col("id") % 3).alias("c"))
    out = S.exact_sample(df, "id", frac=0.5, by="c").toPandas()
    assert out[out.c.isna()].sampled.sum() == 5 and out.sampled.sum() == 15


def test_pu_filters_reach_the_scan(spark):
    """A label threshold used as a filter is pushed to the Parquet scan."""
    ev = spark.read.parquet("/root/testdata/sf0.001/events.parquet").where(greater("value", 100.0)).select("event_id")
    plan = ev._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(value,100.0)" in plan
