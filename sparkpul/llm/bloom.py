"""A blocked Bloom filter as a small DataFrame, built and probed with built-in functions.

A key hashes to one block of four 64-bit words and sets one bit in each word, so a probe
reads a single block. The blocks are the rows of a table that is broadcast: its size is
fixed by ``max_blocks`` (40 bytes a row), not by the number of keys. With more keys than
that suits, the share of false positives rises; callers must follow with an exact join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORDS = 4
KEYS_PER_BLOCK = 16
MAX_BLOCKS = 1 << 18


def _block(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int")


def _masks(key: Column) -> list[Column]:
    bits = F.xxhash64(F.lit("bits"), key)
    return [
        F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftright(bits, 6 * w).bitwiseAND(63).cast("int"))
        for w in range(WORDS)
    ]


class BlockedBloom:
    """The filter of the values of ``key`` in ``listed`` (nulls are not listed)."""

    def __init__(self, listed: DataFrame, key: str, max_blocks: int = MAX_BLOCKS):
        keys = listed.select(F.col(key).alias("k")).where(F.col("k").isNotNull())
        n = keys.count()
        self.blocks = 1
        while self.blocks < max_blocks and self.blocks * KEYS_PER_BLOCK < n:
            self.blocks *= 2
        masks = _masks(F.col("k"))
        self.table = keys.groupBy(_block(F.col("k"), self.blocks).alias("__bloom_block")).agg(
            *[F.bit_or(m).alias(f"__bloom_{w}") for w, m in enumerate(masks)]
        )

    def marked(self, df: DataFrame, key: str, name: str) -> DataFrame:
        """``df`` with a column ``name``: whether ``key`` may be listed (null: no)."""
        names = df.columns
        probed = df.withColumn("__bloom_block", _block(F.col(key), self.blocks)).join(
            F.broadcast(self.table), "__bloom_block", "left"  # at most max_blocks rows of 40 bytes
        )
        hit = F.col(key).isNotNull()
        for w, m in enumerate(_masks(F.col(key))):
            hit = hit & (F.coalesce(f"__bloom_{w}", F.lit(0)).bitwiseAND(m) != 0)
        return probed.select(*names, hit.alias(name))

    def possible(self, df: DataFrame, key: str) -> DataFrame:
        """The rows of ``df`` whose ``key`` may be listed: no listed key is lost."""
        probed = df.withColumn("__bloom_block", _block(F.col(key), self.blocks)).join(
            F.broadcast(self.table), "__bloom_block"  # at most max_blocks rows of 40 bytes
        )
        hit = F.lit(True)
        for w, m in enumerate(_masks(F.col(key))):
            hit = hit & (F.col(f"__bloom_{w}").bitwiseAND(m) != 0)
        return probed.where(hit).select(*df.columns)
