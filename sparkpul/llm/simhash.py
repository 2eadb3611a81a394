"""SimHash near-duplicates by pivot distance tables (operator 1).

Every text gets a 64-bit fingerprint; fingerprints link at ``max_bits`` or fewer
differing bits; documents of linked fingerprints form a component.

The search works on distinct fingerprints (copies count once) and on their Hamming
distances to reference fingerprints, the pivots:

* axis pivots: the zero fingerprint and the 64 single-bit ones. Going from zero to axis
  j changes a fingerprint's distance by +1 or -1, so these coordinates are its bits. The
  axes are split into ``max_bits + 3`` families. Two linked fingerprints differ in at
  most ``max_bits`` axes, so they agree in all coordinates of at least three families:
  each choice of three families is a table, its cells are the agreeing coordinates, and
  only fingerprints of one cell are paired. No link is lost;
* spread pivots: ``PIVOTS`` fixed fingerprints far from each other. By the triangle
  inequality a pair whose distances to any one of them differ by more than ``max_bits``
  is no link, so pairs are discarded by their maximum coordinate difference before the
  survivors' distance is computed.

Cells stay small: one with over ``CELL`` fingerprints (a dense group of near copies) is
not paired but split by the coordinates it does not yet fix, in ``max_bits + 1`` further
families of which a linked pair agrees in at least one. Repeating this ends with cells
that fix all but ``FREE`` axes and so hold at most ``2**FREE`` distinct fingerprints.
Every fingerprint thus meets a bounded number of others, whatever the group.

Defined results: texts without words have fingerprint zero and are linked like any other;
null text is empty; ``component_id`` is the least non-null ``doc_id``; repeated rows give
repeated results; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkpul.llm.bloom import BlockedBloom
from sparkpul.llm.common import map_slices, materialize, packed
from sparkpul.llm.components import components

SHINGLE = 3
MAX_BITS = 3
SEED = 42
PIVOTS = 16
CELL = 64
FREE = 8


# -- fingerprints ------------------------------------------------------------------


def fingerprint(text: str, shingle: int = SHINGLE) -> int:
    """SimHash of one text, unsigned."""
    words = text.encode().lower().split()
    if not words:
        return 0
    if len(words) < shingle:
        words = [b" ".join(words)]
    else:
        words = list(map(b" ".join, zip(*[words[i:] for i in range(shingle)], strict=False)))
    hashes = np.array([xxhash.xxh64_intdigest(w, SEED) for w in words], "<u8")
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        block = hashes[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(block, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, keys: tuple[str, ...] = ()) -> DataFrame:
    """``doc_id, fp`` (a signed long with the fingerprint's bits) and the long columns ``keys``,
    in the tasks that read the texts."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [fingerprint(t or "", shingle) for t in batch.column(1).to_pylist()]
        return pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(np.array(found, np.uint64).view(np.int64)), *batch.columns[2:]],
            ["doc_id", "fp", *keys],
        )

    schema = "".join(["doc_id long, fp long", *[f", {k} long" for k in keys]])
    return map_slices(docs.select(F.col("doc_id").cast("long"), "text", *keys), run, schema)


# -- pivot tables ------------------------------------------------------------------


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _families(axes: list[int], count: int) -> list[int]:
    """``axes`` in ``count`` families of near equal size, each as a mask."""
    return [sum(1 << a for a in part.tolist()) for part in np.array_split(np.array(axes, int), count)]


def first_masks(max_bits: int) -> list[int]:
    families = _families(list(range(64)), max_bits + 3)
    return [sum(three) for three in combinations(families, 3)]


def split_masks(mask: int, max_bits: int) -> list[int]:
    """The cells' masks after one split: each fixes one family more of the free axes."""
    free = [a for a in range(64) if not mask >> a & 1]
    return [mask | more for more in _families(free, max_bits + 1)]


def spread_pivots(count: int = PIVOTS) -> list[int]:
    """Fixed reference fingerprints: hashes of their numbers."""
    return [xxhash.xxh64_intdigest(b"pivot %d" % i, SEED) for i in range(count)]


def _axis_coordinates(fp: Column, mask: Column) -> Column:
    """The coordinates of ``fp`` on the axes in ``mask``: whether each distance falls from
    zero's by one. Packed in a long they are the fingerprint's bits under the mask."""
    return fp.bitwiseAND(mask)


def _links(members: DataFrame, max_bits: int) -> DataFrame:
    """Links among the fingerprints of each cell (``mask, cell, fp``)."""
    pivots = spread_pivots()
    distances = [
        F.bit_count(F.col("fp").bitwiseXOR(F.lit(_signed(p)))).cast("byte").alias(f"d{i}") for i, p in enumerate(pivots)
    ]
    table = members.select("mask", "cell", "fp", *distances)
    a, b = table.alias("a"), table.alias("b")
    near = F.lit(True)
    for i in range(len(pivots)):
        near = near & (F.abs(F.col(f"a.d{i}") - F.col(f"b.d{i}")) <= max_bits)
    same_cell = (F.col("a.mask") == F.col("b.mask")) & (F.col("a.cell") == F.col("b.cell"))
    survivors = a.join(b, same_cell & (F.col("a.fp") > F.col("b.fp")) & near)
    apart = F.bit_count(F.col("a.fp").bitwiseXOR(F.col("b.fp")))
    return survivors.where(apart <= max_bits).select(F.col("a.fp").alias("u"), F.col("b.fp").alias("v"))


def linked(distinct: DataFrame, max_bits: int = MAX_BITS, cell: int = CELL) -> DataFrame:
    """``u, v``: all pairs of distinct fingerprints (column ``fp``) within ``max_bits`` bits."""
    masks = first_masks(max_bits)
    members = distinct.select("fp", F.explode(F.array(*[F.lit(_signed(m)) for m in masks])).alias("mask"))
    found = None
    while True:
        members = members.select("mask", _axis_coordinates(F.col("fp"), F.col("mask")).alias("cell"), "fp")
        sizes = members.groupBy("mask", "cell").agg(F.count("*").alias("n")).where("n > 1")
        # cells of one fingerprint, by far the most, go here
        shared = materialize(members.join(sizes, ["mask", "cell"]), "pivot-cells")
        last = F.bit_count("mask") >= 64 - FREE
        pairs = _links(shared.where((F.col("n") <= cell) | last), max_bits)
        found = pairs if found is None else found.unionByName(pairs)
        crowded = shared.where((F.col("n") > cell) & ~last)
        if crowded.isEmpty():
            return found.distinct()
        todo = {m: split_masks(m, max_bits) for m in masks if (m.bit_count() < 64 - FREE)}
        masks = sorted({x for more in todo.values() for x in more})
        steps = F.create_map(*[
            x for m, more in todo.items()
            for x in (F.lit(_signed(m)), F.array(*[F.lit(_signed(y)) for y in more]))
        ])
        members = crowded.select("fp", F.explode(F.element_at(steps, F.col("mask"))).alias("mask")).distinct()


# -- documents ---------------------------------------------------------------------


def _with_least(prints: DataFrame, key: Column, max_bits: int) -> DataFrame:
    """``prints`` with ``least``: the least ``key`` of the fingerprint's component."""
    distinct = materialize(prints.groupBy("fp").agg(F.min(key).alias("first")), "distinct-fingerprints")
    stars = components(linked(distinct.select("fp"), max_bits))
    # only linked fingerprints can get another document's id
    hung = stars.select(F.col("u").alias("fp"), F.col("v").alias("root"))
    nodes = hung.unionByName(stars.select(F.col("v").alias("fp"), F.col("v").alias("root")).distinct())
    rooted = nodes.join(distinct, "fp")
    least = rooted.groupBy("root").agg(F.min("first").alias("least"))
    linked_ids = rooted.select("fp", "root").join(least, "root").select("fp", "least")
    own = distinct.join(linked_ids, "fp", "left").select("fp", F.coalesce("least", "first").alias("least"))
    # written out, so that the last join stands alone and a fingerprint of very many
    # copies can be split among tasks
    own = materialize(own, "components")
    return prints.join(own, "fp")


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, max_bits: int = MAX_BITS) -> DataFrame:
    """``doc_id, fp, component_id`` of every document."""
    prints = materialize(fingerprints(docs, shingle), "fingerprints")
    return _with_least(prints, F.col("doc_id"), max_bits).select("doc_id", "fp", F.col("least").alias("component_id"))


def digests(found: DataFrame) -> DataFrame:
    """The contract columns of operator 1."""
    return found.select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"
    )


def drop_near_duplicates(docs: DataFrame, shingle: int = SHINGLE, max_bits: int = MAX_BITS) -> DataFrame:
    """``docs`` with one document of each component; columns as they are.

    A document is a ``doc_id`` with a text: other texts under its id are other documents,
    and rows equal in both are one document given more than once, which stay or go
    together. Without an id every row is a document of its own. The least ``doc_id`` (a row
    without one only if no other has one), then the least hash of the text, stays.

    Only documents that a Bloom filter of the dropped ones lets pass are joined (and so
    shuffled), and rows without an id, which are gathered by their text.
    """
    doc_id, text_hash = F.col("doc_id").cast("long"), F.xxhash64(F.coalesce("text", F.lit("")))
    hashed = docs.select("doc_id", "text", text_hash.alias("text_hash"))
    prints = materialize(fingerprints(hashed, shingle, ("text_hash",)), "fingerprints")
    key = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "text_hash")
    lost = _with_least(prints, key, max_bits).where(~key.eqNullSafe(F.col("least")))
    dropped = materialize(
        lost.select(
            F.col("doc_id").alias("lost_id"), F.col("text_hash").alias("lost_hash"),
            F.xxhash64("doc_id", "text_hash").alias("lost_pair"),
        ).distinct(),
        "dropped",
    )
    own = packed(docs, id=doc_id, hash=text_hash)
    named = own.where("id is not null").withColumn("pair", F.xxhash64("id", "hash"))
    marked = BlockedBloom(dropped, "lost_pair").marked(named, "pair", "maybe")
    clean = marked.where("not maybe").select("row.*")
    same = (F.col("id") == F.col("lost_id")) & (F.col("hash") == F.col("lost_hash"))
    kept = marked.where("maybe").join(dropped, same, "left_anti").select("row.*")
    unnamed = own.where("id is null").join(
        dropped.where("lost_id is null"), F.col("hash") == F.col("lost_hash"), "left_anti"
    )
    # one row of those equal in text: JSON stands for columns that have no order, as maps
    rank = F.xxhash64(F.to_json("row"))
    single = unnamed.groupBy("hash").agg(F.min_by("row", rank).alias("row")).select("row.*")
    return clean.unionByName(kept).unionByName(single)
