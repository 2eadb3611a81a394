"""Sources and sinks.

* Scored CSV tables with a declared schema and a rooted path column (S1-S5).
* A Parquet feature store keyed by (experiment, extractor) that computes only the
  ids it does not hold yet (S6) with a batched extractor function (S7).
* Quarantine of rows whose payload does not validate (S8).
* Result files: write with lists as JSON text, skip finished cells, overwrite one
  cell, read back and stack with a setting tag (S9-S12).
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import label, path_join
from ..operators.splits import pn_test_split

# ----------------------------------------------------------------------------- CSV


def read_scored_csv(
    spark: SparkSession, path: str | Sequence[str], schema: T.StructType | str, path_col: str | None = None, root: str = ""
) -> DataFrame:
    """CSV with header and a declared schema (no inference); the path column is
    rooted with ``os.path.join`` semantics (S1, S2)."""
    df = spark.read.schema(schema).option("header", True).csv(path)
    if path_col:
        df = df.withColumn(path_col, path_join(root, path_col))
    return df


def load_paths(df: DataFrame, path_col: str) -> DataFrame:
    """Only the rooted path column."""
    return df.select(path_col)


def positive_unlabeled_paths(df: DataFrame, path_col: str, positive: Column) -> DataFrame:
    """Paths labelled positive (1) or unlabeled (0) by one predicate (S3, documented intent)."""
    return df.select(path_col, label(positive).alias("y_pu"))


def pu_with_test(df: DataFrame, id_col: str, path_col: str, reliable: Column, positive: Column, test_frac: float, seed: int = 1234) -> DataFrame:
    """PU train paths and PN test paths (S4): test rows carry ``y_true``, train rows
    ``y_pu`` by the reliable predicate."""
    s = pn_test_split(df, id_col, reliable, positive, test_frac, seed)
    return s.select(id_col, path_col, "split", "y_pu", "y_true")


def pn_with_test(df: DataFrame, id_col: str, path_col: str, positive: Column, test_frac: float, seed: int = 1234) -> DataFrame:
    """PN train paths and PN test paths by one predicate."""
    s = pn_test_split(df, id_col, positive, positive, test_frac, seed)
    return s.select(id_col, path_col, "split", "y_true")


# ----------------------------------------------------------------------------- features


def batch_extractor(fn: Callable[[pd.Series], np.ndarray], dim: int):
    """Wrap ``fn(batch) -> (rows, dim) array`` as an Arrow-batched UDF.

    The caller supplies the model function; it sees whole column batches.
    """

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def _extract(batch: pd.Series) -> pd.Series:
        out = np.asarray(fn(batch), dtype=np.float64).reshape(len(batch), dim)
        return pd.Series(list(out))

    return _extract


# Rows per model call, as the reference chunks its images (fixed value).
EXTRACT_BATCH = 900


def tensor_extractor(make_predict_fn: Callable, in_dim: int, batch_size: int = EXTRACT_BATCH):
    """Numeric-array model inference with ``predict_batch_udf``.

    ``make_predict_fn()`` returns ``fn(x: ndarray[batch, in_dim]) -> ndarray[batch, out]``;
    it is called once per Python worker, and Spark feeds it batches of ``batch_size``.
    """
    from pyspark.ml.functions import predict_batch_udf

    return predict_batch_udf(
        make_predict_fn,
        return_type=T.ArrayType(T.DoubleType()),
        batch_size=batch_size,
        input_tensor_shapes=[[in_dim]],
    )


def feature_store(
    df: DataFrame,
    id_col: str,
    input_col: str,
    store_path: str,
    experiment: str,
    extractor: str,
    extract: Callable[[Column], Column],
) -> DataFrame:
    """Features of the requested rows from a Parquet store, computing the missing ones.

    The store is partitioned by ``experiment, extractor``; rows are keyed by id, so a
    request for other ids than last time computes exactly those (the reference cache
    ignores which images were asked for).
    """
    from ..session import ship_package

    spark = df.sparkSession
    ship_package(spark)
    wanted = df.select(id_col, input_col)
    # an id asked for twice is extracted once
    once = wanted.dropDuplicates([id_col])
    missing = once
    if path_exists(spark, store_path):
        missing = once.join(_stored(spark, store_path, experiment, extractor, id_col).select(id_col), id_col, "left_anti")
    new = missing.select(id_col, extract(F.col(input_col)).alias("features")).withColumn(
        "experiment", F.lit(experiment)
    ).withColumn("extractor", F.lit(extractor))
    new.write.mode("append").partitionBy("experiment", "extractor").parquet(store_path)
    # two writers may have stored an id at the same time: one row per id is read
    stored = _stored(spark, store_path, experiment, extractor, id_col).dropDuplicates([id_col])
    return wanted.select(id_col).join(stored, id_col, "inner")


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether ``path`` exists, asked of the file system Spark uses for it."""
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop_path)


def _stored(spark: SparkSession, path: str, experiment: str, extractor: str, id_col: str) -> DataFrame:
    return (
        spark.read.parquet(path)
        .where((F.col("experiment") == experiment) & (F.col("extractor") == extractor))
        .select(id_col, "features")
    )


def attach_features(df: DataFrame, feats: DataFrame, id_col: str) -> DataFrame:
    """Attach features by id, an equi-join in place of the positional paste."""
    return df.join(feats, id_col, "inner")


# ----------------------------------------------------------------------------- quarantine


def validity(df: DataFrame, is_valid: Column, out: str = "valid") -> DataFrame:
    """``df`` with a flag whether its payload validates; null counts as invalid."""
    return df.withColumn(out, F.coalesce(is_valid, F.lit(False)))


def quarantine(df: DataFrame, is_valid: Column) -> tuple[DataFrame, DataFrame]:
    """Split rows whose payload validates from the rest."""
    flagged = validity(df, is_valid, "_ok")
    return flagged.where("_ok").drop("_ok"), flagged.where(~F.col("_ok")).drop("_ok")


# ----------------------------------------------------------------------------- results


def lists_to_text(df: DataFrame) -> DataFrame:
    """Array columns -> JSON text, as result CSVs store them."""
    out = df
    for f in df.schema.fields:
        if isinstance(f.dataType, T.ArrayType):
            out = out.withColumn(f.name, F.to_json(F.col(f.name)))
    return out


def write_results(df: DataFrame, path: str, keys: Sequence[str] = (), fmt: str = "parquet", skip_existing: bool = False) -> None:
    """Write a result table (S9). ``keys`` partition the files by cell and only the
    cells present in ``df`` are replaced (dynamic partition overwrite, S11);
    ``skip_existing`` leaves an existing result untouched (S10)."""
    data = lists_to_text(df) if fmt == "csv" else df
    w = data.write.option("header", True) if fmt == "csv" else data.write
    if skip_existing:
        w.mode("ignore").format(fmt).save(path)
        return
    if keys:
        # an option of this write alone: the session's setting is left as it is
        w = w.option("partitionOverwriteMode", "dynamic")
        w.mode("overwrite").partitionBy(*keys).format(fmt).save(path)
    else:
        w.mode("overwrite").format(fmt).save(path)


def stack_results(spark: SparkSession, files: Sequence[tuple[str, str]], schema: T.StructType | str, tag: str = "setting") -> DataFrame:
    """Read result CSVs, tag each with its setting and stack them."""
    frames = [
        spark.read.schema(schema).option("header", True).csv(path).select(F.lit(setting).alias(tag), "*")
        for path, setting in files
    ]
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out
