"""The texts of operator 6 are dealt by block once."""

from pyspark.sql import functions as F

from sparkpul.llm import fingerprints


def test_texts_stay_where_they_were_dealt(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"text {i}. more {i % 7}.") for i in range(600)], "doc_id long, text string")
    monkeypatch.setitem(fingerprints.with_next.__globals__, "BLOCK", 16)
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = fingerprints.with_next(docs)
        plan = found._jdf.queryExecution().executedPlan().toString()
        rows = found.orderBy("doc_id").select("doc_id", "next_text").collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    joins = [line for line in plan.splitlines() if "SortMergeJoin" in line and "block" in line]
    assert joins and not any("cast(" in line for line in joins)
    assert [r["next_text"] for r in rows] == [f"text {(i + 1) % 600}. more {(i + 1) % 600 % 7}." for i in range(600)]
    assert fingerprints.edited_fingerprints(docs).agg(F.count("*")).first()[0] == 600
