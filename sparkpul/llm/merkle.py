"""Merkle manifest of a dataset: a digest per row, a tree per group, a root over the groups.

``H`` is the lowercase hexadecimal SHA-256 of its inputs concatenated, digests as text. In
every group the leaves are ordered; while several nodes remain, every ``fanout`` consecutive
ones (the last run may be shorter) become their ``H``. The subroots of the groups, ordered
by group, are the leaves of one more tree of the same kind, whose root stands for all rows.

Plan. Leaf digests are built from built-in functions while the table is read; afterwards
only ids and digests move. A range partitioning by (group, order, digest) and the
counts of its partitions give every leaf its position, so a group may hold any share of
the rows. Aligned runs of ``fanout ** depth`` leaves (at most ``BLOCK``) are the blocks:
each is hashed in one task. What lies above is a butterfly exchange between the blocks of
a group: in round r the ``fanout`` blocks whose numbers differ in digit r alone meet, swap
the roots of their subtrees, and each hashes the same parent for itself. After as many
rounds as the tree has levels every block holds the subroot *and* all siblings on its way
up, so no pass leads down again: each block hashes its own leaves once more and hands out
whole proofs. Numbers of blocks that are no power of the fanout are filled up with blocks
without a node, which hash to nothing and take part like others, so every meeting has
exactly ``fanout`` members; there are fewer than ``fanout`` times as many rows as blocks.

A proof is a list of levels, each with the digests left and right of the way, concatenated;
``fold`` recomputes a root from any leaf digest and it.

Odd rows: nulls are encoded as ``-``, apart from every value; an empty text is ``0:``. Null
order values come first, rows with equal ones are ordered by leaf digest, and equal rows
are equal leaves, of which it does not matter who stands where. A null group is a group,
the first. An empty table gives an empty manifest. Columns that are not named play no part,
whatever their names.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StringType, StructType

from sparkpul.llm.common import materialize

#: leaves of a block at most
BLOCK = 4096
#: rows of a partition of the range partitioning, about
ROWS_PER_RANGE = 1 << 18

PROOF = "array<struct<left: string, right: string>>"


def encoded(value: Column) -> Column:
    """``-`` for null, else byte count, ``:`` and value (as UTF-8 text)."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(values: Sequence[Column]) -> Column:
    """The digest of a row with these values."""
    return F.sha2(F.concat(*[encoded(v) for v in values]), 256)


def fold(start: Column, proof: Column) -> Column:
    """The root that a leaf digest and a proof lead to."""
    return F.aggregate(proof, start, lambda node, at: F.sha2(F.concat(at["left"], node, at["right"]), 256))


def proof_text(proof: Column) -> Column:
    """All siblings of a proof, level by level, left to right, concatenated."""
    return F.array_join(F.transform(proof, lambda at: F.concat(at["left"], at["right"])), "")


def positions(leaves: DataFrame, group: str, order: Sequence[str]) -> DataFrame:
    """``leaves`` with ``pos``, the place of a row in its group from 0, and ``total``, the
    rows of the group. ``order`` must tell the rows of a group apart."""
    n = leaves.count()
    ranges = max(1, -(-n // ROWS_PER_RANGE), min(n // 1024, leaves.sparkSession.sparkContext.defaultParallelism))
    dealt = materialize(
        leaves.repartitionByRange(ranges, group, *order).withColumn("part", F.spark_partition_id()), "merkle-ranges"
    )
    counts = dealt.groupBy("part", group).agg(F.count("*").alias("n"))
    whole = Window.partitionBy(group)
    before = whole.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(
        "part",
        F.col(group).alias("g"),
        F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"),
        F.sum("n").over(whole).alias("total"),
    )
    inside = dealt.withColumn("k", F.row_number().over(Window.partitionBy("part", group).orderBy(*order)))
    placed = inside.join(
        counts.withColumnRenamed("part", "p"), (F.col("part") == F.col("p")) & F.col(group).eqNullSafe(F.col("g"))
    )
    return placed.select(*leaves.columns, (F.col("offset") + F.col("k") - 1).alias("pos"), "total")


def levels(nodes: list[str], fanout: int, height: int | None) -> list[list[str]]:
    """All levels of the tree over ``nodes``: ``height`` steps, or up to a single node."""
    out = [nodes]
    while len(out) - 1 < height if height is not None else len(out[-1]) > 1:
        now = out[-1]
        out.append([sha256("".join(now[i : i + fanout]).encode()).hexdigest() for i in range(0, len(now), fanout)])
    return out


def way(tree: list[list[str]], i: int, fanout: int) -> list[dict[str, str]]:
    """The proof of leaf ``i`` inside ``tree``."""
    out = []
    for nodes in tree[:-1]:
        first = i - i % fanout
        out.append({"left": "".join(nodes[first:i]), "right": "".join(nodes[i + 1 : first + fanout])})
        i //= fanout
    return out


def _block_tree(block: pa.Table, fanout: int, depth: int) -> list[list[str]]:
    """The tree over the ordered leaves of a block: to the full depth if its group has
    more blocks, to a single node otherwise."""
    total = block.column("total")[0].as_py()
    return levels(block.column("leaf").to_pylist(), fanout, depth if total > fanout**depth else None)


def butterfly(blocks: DataFrame, fanout: int) -> DataFrame:
    """``grp, block, subroot, path`` of the blocks (``grp, block, blocks, node``) of all
    groups: rounds of meetings of ``fanout`` blocks that differ in one digit."""
    rounds = F.lit(0)
    most = blocks.agg(F.max("blocks")).first()[0] or 1
    size, last = 1, 0
    while size < most:
        rounds = F.when(F.col("blocks") > size, last + 1).otherwise(rounds)
        size, last = size * fanout, last + 1
    filled = reduce(lambda c, r: F.when(F.col("rounds") == r, fanout**r).otherwise(c), range(1, last + 1), F.lit(1))
    state = blocks.withColumn("rounds", rounds).withColumn("filled", filled.cast("long"))
    absent = state.where((F.col("block") == 0) & (F.col("filled") > F.col("blocks"))).select(
        "grp", F.explode(F.sequence("blocks", F.col("filled") - 1)).alias("block"), F.lit(None).cast("string").alias("node"),
        "rounds",
    )
    state = state.select("grp", "block", "node", "rounds").unionByName(absent)
    state = state.withColumn("path", F.array().cast(PROOF))
    done = state.where("rounds = 0")
    for r in range(last):
        step = fanout**r
        block = F.col("block")
        meeting = [
            F.floor(block / F.lit(step * fanout)).alias("run"),
            F.pmod(block, F.lit(step)).alias("place"),
        ]
        met = state.where(F.col("rounds") > r).groupBy("grp", "rounds", *meeting).agg(
            F.array_sort(F.collect_list(F.struct("block", "node", "path"))).alias("members")
        )
        joined = met.withColumn(
            "parent",
            F.when(
                F.exists("members", lambda m: m["node"].isNotNull()),
                F.sha2(F.array_join(F.transform("members", lambda m: m["node"]), ""), 256),
            ),
        ).select("grp", "rounds", "parent", "members", F.posexplode("members").alias("at", "own"))
        left = F.array_join(F.transform(F.slice("members", 1, F.col("at")), lambda m: m["node"]), "")
        right = F.array_join(F.transform(F.slice("members", F.col("at") + 2, fanout), lambda m: m["node"]), "")
        state = joined.select(
            "grp",
            F.col("own.block").alias("block"),
            F.col("parent").alias("node"),
            "rounds",
            F.concat("own.path", F.array(F.struct(left.alias("left"), right.alias("right")))).cast(PROOF).alias("path"),
        )
        done = done.unionByName(state.where(F.col("rounds") == r + 1))
    return done.select("grp", "block", F.col("node").alias("subroot"), "path")


def _depth(fanout: int) -> int:
    """Levels of a block: as many as fit ``BLOCK`` leaves."""
    depth = 1
    while fanout ** (depth + 1) <= BLOCK:
        depth += 1
    return depth


def _trees(leaves: DataFrame, fanout: int) -> tuple[DataFrame, DataFrame]:
    """One tree per group of ``grp, key, leaf, row`` (``key``: a struct that orders a group,
    ``row``: a struct to carry): the leaves dealt to blocks, and per block of every group
    ``grp, block, subroot, path`` with the proof from the block's root on."""
    if fanout < 2:
        raise ValueError("a tree needs a fanout of two or more")
    depth = _depth(fanout)
    size = fanout**depth
    leaves = materialize(leaves.withColumn("uid", F.monotonically_increasing_id()), "merkle-leaves")
    placed = positions(leaves, "grp", ["key", "leaf", "uid"]).select(
        "grp",
        F.floor(F.col("pos") / size).alias("block"),
        F.pmod("pos", F.lit(size)).cast("int").alias("i"),
        "total",
        "leaf",
        "row",
    )
    placed = materialize(placed, "merkle-placed")

    def root_of(table: pa.Table) -> pa.Table:
        tree = _block_tree(table.sort_by("i"), fanout, depth)
        return table.slice(0, 1).select(["grp", "block", "total"]).append_column("node", pa.array([tree[-1][0]]))

    schema = StructType([placed.schema[c] for c in ("grp", "block", "total")]).add("node", StringType())
    roots = placed.drop("row").groupBy("grp", "block").applyInArrow(root_of, schema)
    blocks = roots.select("grp", "block", F.ceil(F.col("total") / size).alias("blocks"), "node")
    return placed, materialize(butterfly(materialize(blocks, "merkle-blocks"), fanout), "merkle-above")


def _proofs(placed: DataFrame, above: DataFrame, fanout: int) -> DataFrame:
    """``leaf, row`` and the columns of ``above`` beside ``block`` of all leaves, with
    ``path`` as the whole proof: its part inside the block and that above."""
    depth = _depth(fanout)
    carried = [f for f in above.schema if f.name not in ("grp", "block", "path")]
    out = StructType([placed.schema["leaf"], placed.schema["row"], *carried, above.schema["path"]])
    kinds = to_arrow_schema(out)

    def proofs(rows: pa.Table, upper: pa.Table) -> pa.Table:
        if not rows.num_rows:  # a block that only fills up
            return kinds.empty_table()
        rows = rows.sort_by("i")
        tree = _block_tree(rows, fanout, depth)
        rest = upper.column("path")[0].as_py()
        ways = [way(tree, i, fanout) + rest for i in range(rows.num_rows)]
        same = [pa.array([upper.column(f.name)[0].as_py()] * rows.num_rows, kinds.field(f.name).type) for f in carried]
        return pa.table([rows.column("leaf"), rows.column("row"), *same, pa.array(ways, kinds.field("path").type)], schema=kinds)

    return placed.groupBy("grp", "block").cogroup(above.groupBy("grp", "block")).applyInArrow(proofs, out)


def manifest(
    df: DataFrame,
    values: Sequence[str],
    group: str,
    order: Sequence[str],
    carry: Sequence[Column] = (),
    fanout: int = 2,
) -> DataFrame:
    """``leaf, row, subroot, root, path`` of every row of ``df``.

    ``values`` are the columns a leaf covers, in their order; ``group`` names the tree of a
    row, ``order`` its place there. ``row`` is a struct of the ``order`` columns and of
    ``carry``, expressions over ``df``. ``path`` leads from the leaf over its subroot to
    the root (see ``fold``).
    """
    leaves = df.select(
        F.col(group).alias("grp"),
        F.struct(*order).alias("key"),
        leaf([F.col(v) for v in values]).alias("leaf"),
        F.struct(*order, *carry).alias("row"),
    )
    placed, above = _trees(leaves, fanout)
    subroots = above.where("block = 0").select(
        F.lit(0).alias("grp"), F.struct("grp").alias("key"), F.col("subroot").alias("leaf"), F.struct("grp").alias("row")
    )
    top = _proofs(*_trees(subroots, fanout), fanout).select(
        F.col("row.grp").alias("g"), F.col("subroot").alias("root"), F.col("path").alias("rest")
    )
    whole = above.join(top, F.col("grp").eqNullSafe(F.col("g"))).select(
        "grp", "block", "subroot", "root", F.concat("path", "rest").alias("path")
    )
    return _proofs(placed, whole, fanout)


#: what a leaf of ``documents`` covers
LEAF = ("doc_id", "source", "lang", "n_chars", "text")


def document_manifest(docs: DataFrame) -> DataFrame:
    """The manifest of ``documents``, one tree a ``lang``, and the digest of each row with
    1 added to ``n_chars``."""
    n_chars = (F.col("n_chars").cast("decimal(20,0)") + 1).alias("n_chars")
    altered = leaf([n_chars if c == "n_chars" else F.col(c) for c in LEAF])
    changed = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(7)) == 0
    return manifest(docs, LEAF, "lang", ["doc_id"], [F.when(changed, altered).alias("altered")])


def digests(proved: DataFrame) -> DataFrame:
    """One row per document: its digests, and whether the leaf, altered where 7 divides
    the CRC-32 of its id, still leads to the root."""
    return proved.select(
        F.col("row.doc_id").alias("doc_id"),
        "leaf",
        "subroot",
        "root",
        F.sha2(proof_text(F.col("path")), 256).alias("proof_sha256"),
        fold(F.coalesce("row.altered", "leaf"), F.col("path")).alias("folded_root"),
    ).withColumn("verified", F.col("folded_root") == F.col("root"))
