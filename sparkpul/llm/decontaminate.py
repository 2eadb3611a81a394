"""Benchmark decontamination by size-partitioned MinHash containment search (operator 10).

A test item is in a document if the document holds at least ``threshold`` of the item's
distinct word shingles. Items are far shorter than documents, so the similarity of the
two sets says little; what counts is containment in the item. The search is therefore
asymmetric, and partitioned by size:

* items fall into partitions by the power of two of their number of shingles; all items
  of a partition get a MinHash signature of the same length, their lowest shingle hashes.
  The length is ``u - ceil(threshold * u) + 1`` for the partition's largest size u: a
  document that holds enough of the item cannot miss all of so many values, so no true
  pair is lost, whatever the document's length;
* a document is compared with the partitions whose items it is long enough to hold. Its
  shingle hashes are probed against a blocked Bloom filter of all signature values, and
  those that pass are joined with the signatures. What remains are candidate pairs.

Candidates are verified exactly: only candidate documents are read again and shuffled,
and their distinct shingles (as text, not as hashes) are counted per candidate item.

DataFrame functions only; two scans of the documents, the second one kept to candidates
by a Bloom filter of their keys. Words are lower-cased runs of characters other than
``\\x20\\x09-\\x0D``; a text of fewer words than a shingle is one shingle.

Defined results: null and empty texts hold and are nothing; rows with one ``doc_id``
(``item_id``) count each for itself, and a pair of ids gets its best containment; null ids
are kept; extra columns are ignored; an empty table on either side gives no pairs. Which
rows go is told by ``doc_id`` and text together, so a clean text stays whatever other texts
share its id, a null id included.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkpul.llm.bloom import BlockedBloom
from sparkpul.llm.common import SPACE_CLASS, let, materialize, packed

SHINGLE = 5
THRESHOLD = 0.8


def _words(text: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), SPACE_CLASS + "+"), lambda w: w != "")


def _starts(words: Column, k: int) -> Column:
    n = F.size(words)
    return F.when(n == 0, F.array().cast("array<int>")).otherwise(
        F.sequence(F.lit(1), F.greatest(n - k + 1, F.lit(1)))
    )


def shingles(words: Column, k: int) -> Column:
    """Distinct shingles as text."""
    return let(
        words,
        lambda w: F.array_distinct(F.transform(_starts(w, k), lambda i: F.array_join(F.slice(w, i, k), " "))),
    )


def shingle_hashes(words: Column, k: int) -> Column:
    """A hash per shingle, repeats included, from the hashes of its words."""
    return let(
        F.transform(words, lambda w: F.xxhash64(w)),
        lambda h: F.transform(_starts(h, k), lambda i: F.xxhash64(*[F.get(h, i - 1 + j) for j in range(k)])),
    )


def _need(n: Column, threshold: float) -> Column:
    return F.ceil(n * F.lit(threshold) - 1e-9)


def signatures(items: DataFrame, k: int, threshold: float) -> DataFrame:
    """``item, need, value``: the MinHash signature of every item, by size partition."""
    hashes = items.select("item", F.array_sort(F.array_distinct(shingle_hashes(F.col("words"), k))).alias("h"))
    n = F.size("h")
    partition = F.floor(F.log2(n))
    most = F.pow(2, partition + 1) - 1
    length = (most - _need(most, threshold) + 1).cast("int")
    return hashes.where(n > 0).select(
        "item", _need(n, threshold).alias("need"), F.explode(F.slice("h", F.lit(1), length)).alias("value")
    )


def _held_items(docs: DataFrame, items: DataFrame, k: int, threshold: float) -> DataFrame:
    """``doc_id, text_hash, item, matched, item_shingles`` of every text and item at the threshold."""
    items = items.select("item_id", F.col("text").alias("t")).distinct().select(
        F.struct("item_id", F.xxhash64("t").alias("hash")).alias("item"), _words(F.col("t")).alias("words")
    )
    signed = materialize(signatures(items, k, threshold), "item-signatures")
    key = F.xxhash64(F.coalesce("text", F.lit("")))
    own = docs.select("doc_id", key.alias("text_hash"), "text").select(
        "doc_id", "text_hash", _words(F.col("text")).alias("words")
    )

    probes = own.select(
        "doc_id", "text_hash", F.size("words").alias("n_words"), F.explode(shingle_hashes(F.col("words"), k)).alias("value")
    )
    possible = BlockedBloom(signed, "value").possible(probes, "value")
    room = F.greatest(F.col("n_words") - k + 1, F.lit(1)) >= F.col("need")
    candidates = materialize(
        possible.join(signed, "value").where(room).select("doc_id", "text_hash", "item").distinct(), "leak-candidates"
    )

    suspects = candidates.select(F.col("doc_id").alias("id"), F.col("text_hash").alias("hash")).distinct()
    again = BlockedBloom(suspects, "hash").possible(own, "text_hash").join(
        suspects, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("text_hash") == F.col("hash")), "left_semi"
    )
    held = again.select("doc_id", "text_hash", F.explode(shingles(F.col("words"), k)).alias("shingle")).distinct()
    asked = items.select("item", shingles(F.col("words"), k).alias("s")).select(
        "item", F.size("s").alias("item_shingles"), F.explode("s").alias("shingle")
    )
    counted = held.join(asked, "shingle").groupBy("doc_id", "text_hash", "item").agg(
        F.count("*").alias("matched"), F.max("item_shingles").cast("long").alias("item_shingles")
    )
    pair = F.struct("doc_id", "text_hash", "item")
    searched = candidates.select(F.xxhash64("doc_id", "text_hash", "item.item_id", "item.hash").alias("pair_key"), pair.alias("pair"))
    verified = counted.where(F.col("matched") >= _need(F.col("item_shingles"), threshold)).withColumn("own", pair)
    return verified.withColumn("own_key", F.xxhash64("doc_id", "text_hash", "item.item_id", "item.hash")).join(
        searched, (F.col("own_key") == F.col("pair_key")) & F.col("own").eqNullSafe(F.col("pair")), "left_semi"
    )


def contained_items(
    docs: DataFrame, items: DataFrame, k: int = SHINGLE, threshold: float = THRESHOLD
) -> DataFrame:
    """``doc_id, item_id, matched, item_shingles, containment`` of every pair at the threshold."""
    best = F.struct(
        (F.col("matched") / F.col("item_shingles")).alias("containment"), F.col("matched"), F.col("item_shingles")
    )
    return (
        _held_items(docs, items, k, threshold).groupBy("doc_id", F.col("item.item_id").alias("item_id")).agg(F.max(best).alias("best"))
        .select("doc_id", "item_id", "best.matched", "best.item_shingles", "best.containment")
    )


def decontaminate(
    docs: DataFrame, items: DataFrame, k: int = SHINGLE, threshold: float = THRESHOLD
) -> DataFrame:
    """``docs`` without the rows whose text holds a test item; columns as they are.

    Only rows that a Bloom filter of the flagged texts lets pass are joined.
    """
    held = _held_items(docs, items, k, threshold)
    flagged = materialize(
        held.select(F.col("doc_id").alias("leaked_id"), F.col("text_hash").alias("leaked")).distinct(), "leaks"
    )
    own = packed(docs, id=F.col("doc_id"), hash=F.xxhash64(F.coalesce("text", F.lit(""))))
    marked = BlockedBloom(flagged, "leaked").marked(own, "hash", "maybe")
    clean = marked.where("not maybe").select("row.*")
    same = F.col("id").eqNullSafe(F.col("leaked_id")) & (F.col("hash") == F.col("leaked"))
    kept = marked.where("maybe").join(flagged, same, "left_anti").select("row.*")
    return clean.unionByName(kept)
