"""Buckets follow the rows, not the number of shuffle partitions alone."""

from sparkpul import session


def test_few_rows_make_few_buckets(spark, monkeypatch):
    df = spark.range(1000).selectExpr("id", "id * 2 as x")
    few = session.materialize_bucketed(df, "few", "id")
    assert few.rdd.getNumPartitions() == 1
    monkeypatch.setattr(session, "BUCKET_ROWS", 300)
    more = session.materialize_bucketed(df, "more", "id")
    assert more.rdd.getNumPartitions() == 4
    ids = spark.range(0, 1000, 3).hint("merge")
    joined = more.join(ids, "id")
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1  # the ids alone move
    assert sorted(r["x"] for r in joined.collect()) == list(range(0, 2000, 6))
