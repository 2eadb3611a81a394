"""The corpus pipeline: five stages over ``documents``, each written as Parquet and read again.

Each stage takes ``(spark, docs, sf_dir)`` and works on everything its predecessor kept.
All but the last return the columns of ``documents``:

1. quality classifier: documents scored under 0.3 go;
2. SimHash near-dedup: one document (the least ``doc_id``) of each component stays, with
   3-word shingles and at most 3 differing bits;
3. benchmark decontamination: documents that hold a test item go;
4. secret scan: every span found in a text is replaced by ``[SECRET]``;
5. byte-level BPE: ids of the remaining texts, their digests, and those of the decoded bytes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkpul.llm import bpe, decontaminate, quality, secrets, simhash
from sparkpul.llm.common import materialize, table
from sparkpul.session import ensure_checkpoint_dir, ship_package


def _ready(spark: SparkSession) -> None:
    ensure_checkpoint_dir(spark)
    ship_package(spark)


def keep_good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    _ready(spark)
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    _ready(spark)
    return simhash.drop_near_duplicates(docs, simhash.SHINGLE, simhash.MAX_BITS)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    _ready(spark)
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    _ready(spark)
    return secrets.redact(docs)


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    _ready(spark)
    ids = F.col("token_ids").cast("array<string>")
    return bpe.encode_documents(docs).select(
        "doc_id",
        F.size("token_ids").cast("long").alias("n_tokens"),
        "token_ids",
        F.sha2(F.concat_ws(" ", ids), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


STAGES = [
    ("quality classifier", keep_good_quality),
    ("simhash near-dedup", drop_near_duplicates),
    ("benchmark decontamination", drop_benchmark_leaks),
    ("secret scan", mask_secrets),
    ("byte-level bpe", encode_tokens),
]

# a trained classifier and a tokenizer are not expressible in SQL
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole ``documents`` table."""
    _ready(spark)
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), "pipeline")
    return STAGES[-1][1](spark, docs, sf_dir)
