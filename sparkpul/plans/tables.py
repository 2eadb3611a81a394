"""PU views of the benchmark tables (the TESTDATA mapping of the build plan).

* embeddings -> feature table: known positive ``label < 3``, true positive ``label < 5``.
* events     -> scored rows: reliable ``value > 100``, positive ``value >= 50``.
* lineitem   -> tied scores: score ``l_discount``, label ``l_returnflag = 'R'``.
* orders     -> a result table: method = priority, dataset = order year,
  metric = mean total price.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import greater, label

# Fixed values of the benchmark mapping.
EMB_KNOWN_POSITIVE_BELOW = 3
EMB_POSITIVE_BELOW = 5
EVENTS_RELIABLE_ABOVE = 100.0
EVENTS_POSITIVE_FROM = 50.0


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def embedding_pu(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    return e.select(
        "vec_id",
        F.col("embedding").cast("array<double>").alias("features"),
        label(F.col("label") < EMB_KNOWN_POSITIVE_BELOW).alias("y_pu"),
        label(F.col("label") < EMB_POSITIVE_BELOW).alias("y_true"),
    )


def events_reliable():
    return greater("value", EVENTS_RELIABLE_ABOVE)


def events_positive():
    return greater("value", EVENTS_POSITIVE_FROM, inclusive=True)


def result_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Method x dataset x metric, derived from orders."""
    o = table(spark, sf_dir, "orders")
    return o.groupBy(
        F.col("o_orderpriority").alias("method"),
        F.year("o_orderdate").cast("string").alias("dataset"),
    ).agg(F.avg("o_totalprice").alias("metric"))
