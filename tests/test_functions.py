"""Column helpers F1-F11 against their Python definitions."""

import os
import random

import pytest
from pyspark.sql import functions as F

from sparkpul.functions import columns as C


def test_round_even_is_python_round(spark):
    random.seed(0)
    vals = [69.195, 0.125, 0.375, -0.125, 2.675, 1.005, 0.285, -69.195, 123.455]
    vals += [round(random.uniform(-1000, 1000), 3) for _ in range(2000)]
    df = spark.createDataFrame([(v,) for v in vals], "x double")
    got = [r[0] for r in df.select(C.round_even("x", 2)).collect()]
    assert got == [round(v, 2) for v in vals]


def test_path_join_like_os_path(spark):
    rows = [("a/b.jpg",), ("/abs/c.jpg",)]
    df = spark.createDataFrame(rows, "p string")
    for root in ["/data/img", "/data/img/", "rel"]:
        got = [r[0] for r in df.select(C.path_join(root, "p")).collect()]
        assert got == [os.path.join(root, p) for (p,) in rows]


def test_parse_every_second_and_zip(spark):
    df = spark.createDataFrame([("[1, 0, 1]", "[0.1, 0.9, 0.8, 0.2, 0.3, 0.7]")], "yt string, yp string")
    p = df.select(C.parse_list("yt").alias("t"), C.parse_list("yp").alias("p"))
    p = p.select("t", C.every_second_if_double("p", "t").alias("p"))
    assert p.first()["p"] == [0.9, 0.2, 0.7]
    rows = p.select(C.zip_explode("t", "p")).collect()
    assert [(r["pos"], r["col"]["x"], r["col"]["y"]) for r in rows] == [(0, 1.0, 0.9), (1, 0.0, 0.2), (2, 1.0, 0.7)]
    nested = spark.createDataFrame([("[[0.1], [0.9]]",)], "s string").select(C.parse_list("s", nested=True)).first()[0]
    assert nested == [0.1, 0.9]


def test_pair_step_suffix_title_format(spark):
    df = spark.createDataFrame([(1.0, 2.0, "knn-17", "ava_aadb")], "a double, b double, d string, s string")
    r = df.select(
        C.pair_step("a", "b").alias("s1"), C.pair_step("b", "a").alias("s2"), C.pair_step("a", "a").alias("s3"),
        C.suffix_int("d").alias("k"), C.title_setting("s", 0).alias("t0"), C.title_setting("s", 1).alias("t1"),
        C.format_setting("LAION+{}-{}", F.lit("AVA"), F.lit("AADB")).alias("f"),
    ).first()
    assert (r.s1, r.s2, r.s3, r.k, r.t0, r.t1, r.f) == (0.0, 1.0, 0.5, 17, "AVA", "AADB", "LAION+AVA-AADB")


def test_md5_uniform_in_unit_interval(spark):
    u = spark.range(1000).select(C.md5_uniform(1234, "id").alias("u")).agg(F.min("u"), F.max("u"), F.avg("u")).first()
    assert 0.0 <= u[0] < u[1] < 1.0
    assert u[2] == pytest.approx(0.5, abs=0.05)


def test_clipped_bce(spark):
    r = spark.createDataFrame([(1, 0.0), (0, 1.0)], "y int, p double").select(C.clipped_bce("y", "p").alias("l")).collect()
    import math
    assert r[0]["l"] == pytest.approx(-math.log(1e-7))


def test_parse_list_special_values_and_errors(spark):
    import math

    import pytest

    rows = spark.createDataFrame([(1, "[0.1, nan, -inf, 2]"), (2, "[]"), (3, None)], "i int, s string")
    got = {r["i"]: r["l"] for r in rows.select("i", C.parse_list("s").alias("l")).collect()}
    assert got[1][0] == 0.1 and math.isnan(got[1][1]) and got[1][2] == -math.inf and got[1][3] == 2.0
    assert got[2] == [] and got[3] is None
    for bad in ("0.1, 0.2", "[0.1, x]"):
        with pytest.raises(Exception):
            spark.createDataFrame([(bad,)], "s string").select(C.parse_list("s")).collect()


def test_zip_explode_refuses_lists_of_different_length(spark):
    import pytest

    df = spark.createDataFrame([([1.0, 2.0], [1.0])], "a array<double>, b array<double>")
    with pytest.raises(Exception, match="paired lists of 2 and 1 entries"):
        df.select(C.zip_explode("a", "b")).collect()
