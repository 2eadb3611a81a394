"""Bucketed ranking primitives against pandas on small inputs; the bucket size is
shrunk so that the multi-bucket code path runs."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from sparkpul.functions.columns import md5_key
from sparkpul.operators import ranking


@pytest.fixture
def small_buckets(monkeypatch):
    monkeypatch.setattr(ranking, "ROWS_PER_BUCKET", 7)


def _frame(spark, n=60, seed=3):
    rng = np.random.default_rng(seed)
    pdf = pd.DataFrame({
        "id": np.arange(n, dtype=np.int64),
        "g": rng.integers(0, 3, n).astype(np.int64),
        "s": rng.integers(0, 6, n).astype(float),  # heavy ties
    })
    return pdf, spark.createDataFrame(pdf)


def test_prefix_sums_multi_bucket(spark, small_buckets):
    pdf, df = _frame(spark)
    per = pdf.groupby(["g", "s"]).size().rename("cnt").reset_index()
    sdf = spark.createDataFrame(per)
    out = ranking.prefix_sums(sdf, "s", ["cnt"], by=["g"]).toPandas().sort_values(["g", "s"])
    exp = per.sort_values(["g", "s"]).copy()
    exp["before"] = exp.groupby("g")["cnt"].cumsum() - exp["cnt"]
    assert out["cnt_before"].tolist() == exp["before"].tolist()


def test_prefix_sums_descending(spark, small_buckets):
    pdf = pd.DataFrame({"s": np.arange(30, dtype=float), "v": np.ones(30, dtype=np.int64)})
    out = ranking.prefix_sums(spark.createDataFrame(pdf), "s", ["v"], descending=True).toPandas()
    out = out.sort_values("s")
    assert out["v_before"].tolist() == list(range(29, -1, -1))


@pytest.mark.parametrize("desc", [True, False])
def test_top_n_ties_broken_by_id(spark, small_buckets, desc):
    pdf, df = _frame(spark)
    out = ranking.top_n(df, "s", "id", 11, by=["g"], descending=desc).toPandas()
    for g, part in pdf.groupby("g"):
        order = part.sort_values(["s", "id"], ascending=[not desc, True])
        want = set(order["id"].head(11))
        got = set(out[(out.g == g) & out.selected]["id"])
        assert got == want


def test_global_rank_matches_sort(spark, small_buckets):
    pdf, df = _frame(spark)
    out = ranking.global_rank(df, "s", "id").toPandas().sort_values("rank")
    exp = pdf.sort_values(["s", "id"])
    assert out["id"].tolist() == exp["id"].tolist()
    assert out["rank"].tolist() == list(range(1, len(pdf) + 1))


def test_hash_rank_is_md5_order(spark):
    pdf, df = _frame(spark)
    keyed = df.withColumn("h", md5_key(1234, "id"))
    out = ranking.hash_rank(keyed, "h", "id", by=["g"]).toPandas()
    for g, part in out.groupby("g"):
        exp = part.sort_values(["h", "id"])["id"].tolist()
        got = part.sort_values("rank")["id"].tolist()
        assert got == exp
        assert sorted(part["rank"]) == list(range(1, len(part) + 1))


def test_tail_cuts_disjoint(spark, small_buckets):
    pdf, df = _frame(spark, n=40)
    out = ranking.tail_cuts(df, "s", "id", 0.25).toPandas()
    assert out.low.sum() == 10 and out.high.sum() == 10
    assert not (out.low & out.high).any()
    lows = set(pdf.sort_values(["s", "id"]).head(10)["id"])
    highs = set(pdf.sort_values(["s", "id"], ascending=[False, True]).head(10)["id"])
    assert set(out[out.low]["id"]) == lows
    assert set(out[out.high]["id"]) == highs


def test_hash_rank_two_hex_digits(spark, monkeypatch):
    monkeypatch.setattr(ranking, "ROWS_PER_BUCKET", 4)
    assert ranking.hex_digits_for(300) == 2
    df = spark.range(300).withColumnRenamed("id", "rid")
    keyed = df.withColumn("h", md5_key(7, "rid"))
    out = ranking.hash_rank(keyed, "h", "rid").toPandas()
    assert out.sort_values("rank")["rid"].tolist() == out.sort_values(["h", "rid"])["rid"].tolist()
    assert sorted(out["rank"]) == list(range(1, 301))


def test_null_keys_and_scores_keep_their_rows(spark):
    rows = [(1, None, 0.5), (2, None, 0.7), (3, "a", None), (4, "a", 0.1), (5, "a", 0.9), (6, "b", 0.3)]
    df = spark.createDataFrame(rows, "id long, g string, s double")
    top = ranking.top_n(df, "s", "id", 1, by=["g"]).toPandas()
    assert sorted(top["id"]) == [1, 2, 3, 4, 5, 6]
    assert sorted(top[top.selected]["id"]) == [2, 5, 6]
    tails = ranking.tail_cuts(df, "s", "id", 0.5, by=["g"]).toPandas()
    assert sorted(tails["id"]) == [1, 2, 3, 4, 5, 6]
    assert not tails[tails.id == 3][["low", "high"]].values.any()
    keyed = df.withColumn("h", md5_key(1, "id"))
    ranks = ranking.hash_rank(keyed, "h", "id", by=["g"]).toPandas()
    assert sorted(ranks["id"]) == [1, 2, 3, 4, 5, 6]
    gr = ranking.global_rank(df, "s", "id").toPandas()
    assert sorted(gr["id"]) == [1, 2, 3, 4, 5, 6]
    assert gr[gr.id == 3]["rank"].isna().all()


@pytest.mark.parametrize("rows_per_bucket", [3, 1 << 20])
def test_text_ids_and_null_scores(spark, monkeypatch, rows_per_bucket):
    """Every path gives the same with tiny and huge buckets, for text ids, big integers and null scores."""
    monkeypatch.setattr(ranking, "ROWS_PER_BUCKET", rows_per_bucket)
    pdf, _ = _frame(spark)
    pdf["t"] = [f"id-{i * 7919 % 60:02d}" for i in range(60)]
    pdf["big"] = np.arange(60, dtype=np.int64) + 2**60
    pdf["s"] = pdf["s"].where(pdf["id"] % 4 != 0)
    df = spark.createDataFrame(pdf).withColumn("s", F.expr("nanvl(s, null)"))
    scored = pdf[pdf.s.notna()]
    for key in ("t", "big"):
        order = scored.sort_values(["s", key])
        got = ranking.global_rank(df, "s", key).where("rank is not null").toPandas().sort_values("rank")
        assert got[key].tolist() == order[key].tolist()
        top = ranking.top_n(df, "s", key, 9).toPandas()
        want = scored.sort_values(["s", key], ascending=[False, True])[key].head(9)
        assert set(top[top.selected][key]) == set(want) and len(top) == 60
        tails = ranking.tail_cuts(df, "s", key, 0.2).toPandas()
        assert set(tails[tails.low][key]) == set(order[key].head(9)) and len(tails) == 60
        assert set(tails[tails.high][key]) == set(want)
    text = ranking.prefix_sums(df.select("t", F.lit(1).alias("one")), "t", ["one"], descending=True).toPandas()
    assert text.sort_values("t", ascending=False)["one_before"].tolist() == list(range(60))


def test_tail_cuts_count_scored_rows(spark):
    """Half the scores missing: both tails take 20 % of the scored rows, with and without groups."""
    df = spark.range(10).select("id", F.when(F.col("id") < 5, F.col("id").cast("double")).alias("s"), F.lit(1).alias("g"))
    for by in ((), ["g"]):
        out = ranking.tail_cuts(df, "s", "id", 0.2, by=by).toPandas()
        assert out[out.low]["id"].tolist() == [0] and out[out.high]["id"].tolist() == [4]
