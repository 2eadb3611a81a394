"""Exact dedup against a persistent index of digests, bucketed and sorted by digest.

The index is a table on shared storage: one row per distinct text ever taken in, hashed
into a fixed number of buckets by the SHA-256 of the normalised text and sorted inside
them. New data comes in batches. A batch is reduced to one row per digest before the
shuffle (a group of copies leaves each task as one row, however large), deduplicated by a
sort-merge anti-join with the index, and what is left is appended. The index side of that
join is read bucket by bucket: it is never shuffled, however large it has grown. Beside
the index lies a log of digests, one row per row taken in, from which group sizes and
decisions follow at any time. Texts themselves are not stored and not shuffled.

Texts are equal when they are identical after lower-casing A-Z; a null text is empty. The
first batch that holds a text keeps it; inside a batch the row with the largest id does,
where ids are equal the one with the largest hash of its raw text, and of rows equal in
that too, any one. A null id is less than every other. So loading in descending order of
id keeps the largest id of all, as ``load`` does.

A batch that was cut short is taken in again under its name: its log is written first and
kept once complete, the append takes only digests the index does not hold, so nothing is
doubled. Other columns of the input are neither read nor changed. An empty batch adds
nothing; an empty index gives an empty result.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkpul.llm.common import ascii_lower
from sparkpul.sources.tables import path_exists

#: rows of one digest beyond this share of all rows are decided by a broadcast: at most
#: HOT_SHARE digests can have so many
HOT_SHARE = 1000


def digest(text: Column) -> Column:
    """SHA-256 (binary) of the UTF-8 bytes of a text with A-Z lower-cased."""
    return F.unhex(F.sha2(ascii_lower(F.coalesce(text.cast("string"), F.lit(""))), 256))


class DigestIndex:
    """The index under ``path`` (shared storage); created there with ``buckets`` buckets.

    The number of buckets is part of the layout and is read back from it afterwards.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int | None = None):
        self.spark, self.path = spark, path.rstrip("/")
        layout = f"{self.path}/layout"
        if not path_exists(spark, f"{layout}/_SUCCESS"):
            buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
            spark.range(1).select(F.lit(buckets).alias("buckets")).write.mode("overwrite").parquet(layout)
        self.buckets = spark.read.schema("buckets int").parquet(layout).first()[0]
        self.table = f"digest_index_{uuid.uuid4().hex[:12]}"
        spark.sql(
            f"CREATE TABLE {self.table} (digest BINARY, keep_id BIGINT, keep_row STRUCT<batch: STRING, row: BIGINT>) "
            f"USING parquet OPTIONS (path '{self.path}/index') "
            f"CLUSTERED BY (digest) SORTED BY (digest) INTO {self.buckets} BUCKETS"
        )

    def known(self) -> DataFrame:
        """``digest, keep_id, keep_row``: one row per distinct text."""
        return self.spark.table(self.table)

    def log(self) -> DataFrame:
        """``batch, row, id, raw_hash, digest``: one row per row taken in."""
        schema = "row long, id long, raw_hash long, digest binary, batch string"
        if not path_exists(self.spark, f"{self.path}/log"):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.path}/log")

    def _logged(self, df: DataFrame, batch: str, id_col: str, text_col: str) -> DataFrame:
        path = f"{self.path}/log/batch={batch}"
        if not path_exists(self.spark, f"{path}/_SUCCESS"):
            df.select(
                F.monotonically_increasing_id().alias("row"),
                F.col(id_col).cast("long").alias("id"),
                F.xxhash64(F.col(text_col)).alias("raw_hash"),
                digest(F.col(text_col)).alias("digest"),
            ).write.mode("overwrite").parquet(path)
        return self.spark.read.schema("row long, id long, raw_hash long, digest binary").parquet(path)

    def fresh(self, best: DataFrame) -> DataFrame:
        """The rows of ``best`` (one per digest) whose digest the index does not hold."""
        dealt = best.repartition(self.buckets, "digest")
        return dealt.join(self.known().hint("merge"), "digest", "left_anti")

    def ingest(self, df: DataFrame, batch: str, id_col: str = "doc_id", text_col: str = "text") -> None:
        """Take in the rows of ``df`` as ``batch``: log them and append what is new."""
        rows = self._logged(df, batch, id_col, text_col)
        best = rows.groupBy("digest").agg(F.max(F.struct("id", "raw_hash", "row")).alias("best"))
        new = self.fresh(best).select(
            "digest",
            F.col("best.id").alias("keep_id"),
            F.struct(F.lit(batch).alias("batch"), F.col("best.row").alias("row")).alias("keep_row"),
        )
        new.write.mode("append").bucketBy(self.buckets, "digest").sortBy("digest").format("parquet").option(
            "path", f"{self.path}/index"
        ).saveAsTable(self.table)

    def decisions(self) -> DataFrame:
        """``id, digest, keep_id, group_size, kept``: one row per row ever taken in.

        Rows of the few digests that hold more than ``1 / HOT_SHARE`` of all rows meet
        their group in a broadcast of at most ``HOT_SHARE`` rows; the others are joined
        by digest, where no group is larger than that share.
        """
        rows = self.log()
        sizes = rows.groupBy("digest").agg(F.count("*").alias("group_size")).repartition(self.buckets, "digest")
        groups = self.known().join(sizes.hint("merge"), "digest")
        limit = rows.count() // HOT_SHARE
        hot = F.broadcast(groups.where(F.col("group_size") > limit))  # at most HOT_SHARE rows
        hot = hot.select("digest", *[F.col(c).alias(f"hot_{c}") for c in ("keep_id", "keep_row", "group_size")])
        marked = rows.join(hot, "digest", "left")
        at = F.struct("batch", "row")
        crowded = marked.where("hot_group_size IS NOT NULL").select(
            "id", "digest", F.col("hot_keep_id").alias("keep_id"), F.col("hot_group_size").alias("group_size"),
            (at == F.col("hot_keep_row")).alias("kept"),
        )
        others = marked.where("hot_group_size IS NULL").join(groups.where(F.col("group_size") <= limit), "digest")
        return crowded.unionByName(others.select("id", "digest", "keep_id", "group_size", (at == F.col("keep_row")).alias("kept")))


def load(index: DigestIndex, df: DataFrame, id_col: str = "doc_id", text_col: str = "text", batches: int = 2) -> None:
    """Take a whole table into ``index`` in ``batches`` ranges of ids, the largest ids first,
    so that the largest id of every group stays. Rows without an id come with the last."""
    low, high = df.agg(F.min(id_col), F.max(id_col)).first()
    bounds = [] if low is None else [high - (high - low + 1) * i // batches for i in range(1, batches)]
    above = None
    for i, bound in enumerate([*bounds, None]):
        part = F.lit(True) if bound is None else F.col(id_col) > bound
        if above is not None:
            part = part & (F.col(id_col).isNull() | (F.col(id_col) <= above))
        index.ingest(df.where(part), f"{i:04d}", id_col, text_col)
        above = bound


def keep_new(index: DigestIndex, df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``df`` that ``ingest`` would keep, with all their columns as they are.

    Rows equal in text become one before the shuffle, so copies do not travel.
    """
    packed = df.select(
        digest(F.col(text_col)).alias("digest"),
        F.struct(F.col(id_col).cast("long").alias("id"), F.xxhash64(F.col(text_col)).alias("h")).alias("rank"),
        F.struct(*[df[f"`{c}`"] for c in df.columns]).alias("whole"),
    )
    best = packed.groupBy("digest").agg(F.max_by("whole", "rank").alias("whole"))
    return index.fresh(best).select("whole.*")


def digests(decided: DataFrame) -> DataFrame:
    """The decisions with the digest in hexadecimal."""
    return decided.select(
        F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256")
    )
