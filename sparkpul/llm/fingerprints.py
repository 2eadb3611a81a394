"""Document fingerprints: a homomorphic multiset hash over paragraphs (operator 6).

A paragraph hashes to a wide vector; the fingerprint of a text is the sum of its
paragraphs' vectors, lane by lane modulo a power of two. Order does not matter, equal
multisets have equal fingerprints, and a paragraph is inserted or deleted by adding or
subtracting its vector (``add``, ``subtract``) without the rest of the text.

The vector has two parts. ``EXACT`` lanes of 32 bits modulo 2**32 tell texts apart. The
sketch lanes hold one bit each: their sums count how many paragraphs set the lane, so
``2 * sum - n`` is a random-sign projection of the multiset and the squared distance of
two projections estimates how many paragraphs differ. Three 20-bit lanes share a 60-bit
word and are summed at once (exact up to 2**20 - 1 paragraphs a text; the exact lanes do
not depend on that). A paragraph is a line; a line is cut further after the end of a
sentence, so that single-line texts have parts to compare.

The edited text of a document needs the start of the next one by ``doc_id``. Documents
are dealt by blocks of ``BLOCK`` consecutive ids, and the next row inside a block is a window
function. Ids repeat, or are null: a block with more than ``1 / HOT_SHARE`` of all rows (so
there are fewer than ``HOT_SHARE``) is cut by id and by ranges of the texts' hash into blocks
of about ``BLOCK`` rows again, and rows equal in id and text become one row with a count
before they are shuffled. Only the first row of each block goes to another block: a table of
one row per block, joined on the block the documents are already dealt by. The texts are
shuffled once; the sums by document need no further exchange. The order of blocks comes
from a range partitioning of the blocks alone, and the first block of each partition.

DataFrame functions only. Defined results: null text is empty; an empty text has the zero
vector, two empty texts likeness 1; the next document of the only one is itself; rows
with equal ``doc_id`` are ordered by the hash of their text, null ids come first; extra columns are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sparkpul.llm.common import materialize

#: consecutive ids that share a block
BLOCK = 256
#: blocks with more than one part in so many of all rows are cut further
HOT_SHARE = 1000
#: as read from a file: joins of a block with its like need no cast, which would shuffle again
BLOCK_TYPE = "struct<base: bigint, id: bigint, piece: bigint>"
#: blocks whose order one window task settles, about
SUPER = 1 << 14
EXACT = 4
SKETCH_WORDS = 20
LANE_BITS = 20
LANES = SKETCH_WORDS * 3
LANE_MASK = (1 << LANE_BITS) - 1
PARTS = r"\n+|(?<=[.!?])\s+"
# one bit at the foot of each of the three lanes of a word
FEET = 1 | 1 << LANE_BITS | 1 << (2 * LANE_BITS)


def paragraphs(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), PARTS), lambda p: p != "")


def lanes(part: Column) -> list[Column]:
    """The vector of one paragraph: exact lanes, then sketch words."""
    first, second = F.xxhash64(part), F.xxhash64(F.lit(1), part)
    low = 0xFFFFFFFF
    exact = [h for x in (first, second) for h in (x.bitwiseAND(low), F.shiftrightunsigned(x, 32))]
    bits = F.xxhash64(F.lit(2), part)
    return exact[:EXACT] + [F.shiftright(bits, j).bitwiseAND(FEET) for j in range(SKETCH_WORDS)]


def sums(part: Column, keep: Column | None = None) -> Column:
    """Aggregate expression: the vector of a group of paragraphs, with their number last."""
    def total(x: Column) -> Column:
        return F.coalesce(F.sum(x if keep is None else F.when(keep, x)), F.lit(0).cast("long"))

    vector = [total(x) for x in lanes(part)]
    vector = [x.bitwiseAND(0xFFFFFFFF) for x in vector[:EXACT]] + vector[EXACT:]
    counted = F.lit(1).cast("long")
    n = F.count(F.when(part.isNotNull(), counted) if keep is None else F.when(keep & part.isNotNull(), counted))
    return F.array(*vector, n)


def _lanewise(a: Column, b: Column, sign: int) -> Column:
    out = F.zip_with(a, b, lambda x, y: x + y * sign)
    return F.transform(out, lambda x, i: F.when(i < EXACT, x.bitwiseAND(0xFFFFFFFF)).otherwise(x))


def add(a: Column, b: Column) -> Column:
    """Vector of the union of two multisets of paragraphs."""
    return _lanewise(a, b, 1)


def subtract(a: Column, b: Column) -> Column:
    """Vector of ``a`` without the paragraphs of ``b``, a part of it."""
    return _lanewise(a, b, -1)


def written(vector: Column) -> Column:
    """A vector as text: 8 hex digits per exact lane, 16 per other word."""
    return F.array_join(
        F.transform(
            vector,
            lambda x, i: F.lower(F.when(i < EXACT, F.lpad(F.hex(x), 8, "0")).otherwise(F.lpad(F.hex(x), 16, "0"))),
        ),
        "",
    )


def _signed(vector: Column) -> Column:
    """The signed projections of a vector: ``2 * lane - n``."""
    n = F.element_at(vector, -1)
    words = F.slice(vector, EXACT + 1, SKETCH_WORDS)
    return F.flatten(
        F.transform(
            words,
            lambda x: F.array(*[
                (F.shiftright(x, LANE_BITS * k).bitwiseAND(LANE_MASK) * 2 - n).cast("double") for k in range(3)
            ]),
        )
    )


def likeness(a: Column, b: Column) -> Column:
    """0 to 1: the estimated share of paragraphs two vectors have in common; equal vectors: 1."""
    zero = F.lit(0.0)
    square = lambda v: F.aggregate(v, zero, lambda t, x: t + x * x)
    apart = square(F.zip_with(_signed(a), _signed(b), lambda x, y: x - y))
    both = square(_signed(a)) + square(_signed(b))
    share = F.greatest(zero, 1 - apart / F.greatest(both, F.lit(1.0)))
    return F.when(a == b, F.lit(1.0)).otherwise(share)


def fingerprint_texts(docs: DataFrame) -> DataFrame:
    """``doc_id, vector`` of every text; a document's paragraphs never leave their task
    before they are summed.
    """
    keyed = docs.select("doc_id", F.monotonically_increasing_id().alias("row"), "text")
    parts = keyed.select("doc_id", "row", F.explode_outer(paragraphs(F.col("text"))).alias("part"))
    return parts.groupBy("doc_id", "row").agg(sums(F.col("part")).alias("vector")).drop("row")


def _next_blocks(blocks: DataFrame) -> DataFrame:
    """``block, next_block``: the following block, for the last one the first."""
    ranges = max(1, -(-blocks.count() // SUPER))
    dealt = materialize(blocks.repartitionByRange(ranges, "block").withColumn("part", F.spark_partition_id()), "blocks")
    inside = dealt.withColumn("follow", F.lead("block").over(Window.partitionBy("part").orderBy("block")))
    tops = dealt.groupBy("part").agg(F.min("block").alias("first"))
    order = Window.orderBy("part")  # one row per range
    tops = tops.withColumn("after", F.coalesce(F.lead("first").over(order), F.first("first").over(order)))
    return inside.join(tops, "part").select("block", F.coalesce("follow", "after").alias("next_block"))


def _in_blocks(docs: DataFrame) -> DataFrame:
    """``block, doc_id, hash, text, copies``: rows with their block, equal ones of a crowded
    block as one."""
    none = F.lit(-(2**62))
    keyed = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    keyed = keyed.withColumn("base", F.coalesce(F.floor(F.col("doc_id") / BLOCK), none))
    sizes = keyed.groupBy("base").agg(F.count("*").alias("n"))
    limit = max(4 * BLOCK, (sizes.agg(F.sum("n")).first()[0] or 0) // HOT_SHARE)
    crowded = sizes.where(F.col("n") > limit).select("base", F.ceil(F.col("n") / BLOCK).alias("pieces"))
    found = keyed.join(F.broadcast(crowded), "base", "left").withColumn("hash", F.xxhash64("text"))
    zero = F.lit(0).cast("long")
    # the range of the hash a row falls in; never falls as the hash grows
    piece = F.floor((F.col("hash") / F.lit(2.0**64) + 0.5) * F.col("pieces"))
    cut = F.col("pieces").isNotNull()
    block = F.struct(
        "base",
        F.when(cut, F.coalesce("doc_id", none)).otherwise(zero).alias("id"),
        F.when(cut, F.coalesce(piece, zero)).otherwise(zero).alias("piece"),
    ).cast(BLOCK_TYPE)
    rows = found.select(block.alias("block"), "doc_id", "hash", "text", cut.alias("cut"))
    whole = rows.where("not cut").select("block", "doc_id", "hash", "text", F.lit(1).cast("long").alias("copies"))
    if crowded.isEmpty():
        return whole
    one = rows.where("cut").groupBy("block", "doc_id", "hash", "text").agg(F.count("*").alias("copies"))
    return whole.unionByName(one)


def with_next(docs: DataFrame, partitions: int | None = None) -> DataFrame:
    """``block, place, doc_id, text, copies, next_text`` dealt by ``block``: the next text is
    that behind the last of ``copies`` equal rows."""
    partitions = partitions or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = Window.partitionBy("block").orderBy(F.col("doc_id").asc_nulls_first(), "hash", "text")
    keyed = _in_blocks(docs)
    placed = keyed.repartition(partitions, "block").select(
        "*", F.row_number().over(order).alias("place"), F.lead("text").over(order).alias("after")
    )
    heads = placed.where("place = 1").select(F.col("block").alias("next_block"), F.col("text").alias("head"))
    following = heads.join(_next_blocks(keyed.select("block").distinct()), "next_block").select("block", "head")
    return placed.join(following, "block").select(
        "block", "place", "doc_id", "text", "copies", F.coalesce("after", "head").alias("next_text")
    )


def edited_fingerprints(docs: DataFrame) -> DataFrame:
    """``doc_id, n_chars, edited_sha256, vector, edited_vector, next_vector`` of every document.

    The edited text is the document with its last ``floor(n / 2)`` code points replaced
    by the first as many (or all) of the next document.
    """
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substr("text", F.lit(1), n - half), F.substr("next_text", F.lit(1), half))
    # of equal rows all but the last have the same text behind them
    last = F.struct(F.lit(1).cast("long").alias("times"), F.col("next_text").alias("follow"))
    before = F.struct((F.col("copies") - 1).alias("times"), F.col("text").alias("follow"))
    turns = F.when(F.col("copies") > 1, F.array(last, before)).otherwise(F.array(last))
    texts = with_next(docs).select("block", "place", "doc_id", "text", F.posexplode(turns).alias("turn", "t")).select(
        "block", "place", "turn", "t.times", "doc_id", "text", F.col("t.follow").alias("next_text")
    )
    keys = ["block", "place", "turn", "times", "doc_id", "n_chars", "edited_sha256"]
    texts = texts.select(*keys[:5], n.cast("long").alias("n_chars"), "text", "next_text", edited.alias("edited"))
    of = F.array("text", "edited", "next_text")
    parts = texts.select(
        *keys[:6], F.sha2("edited", 256).alias("edited_sha256"), F.posexplode(of).alias("which", "one")
    ).select(*keys, "which", F.explode_outer(paragraphs(F.col("one"))).alias("part"))
    part, which = F.col("part"), F.col("which")
    found = parts.groupBy(*keys).agg(
        sums(part, which == 0).alias("vector"),
        sums(part, which == 1).alias("edited_vector"),
        sums(part, which == 2).alias("next_vector"),
    )
    again = found.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "times")))
    return again.drop("block", "place", "turn", "times", "copy")


def digests(found: DataFrame) -> DataFrame:
    """The contract columns of operator 6."""
    v, e, x = F.col("vector"), F.col("edited_vector"), F.col("next_vector")
    return found.select(
        "doc_id", "n_chars", "edited_sha256", written(v).alias("fingerprint"), written(e).alias("edited_fingerprint"),
        likeness(v, e).alias("near_edited"), likeness(v, x).alias("near_next"),
    )
