"""Connected components of an edge table by alternating star contraction.

Each round turns the edges into stars around smaller nodes (first from the larger, then
from the smaller neighbours) until every node hangs on the least node of its component.
A round is two joins on nodes, its result a written table; the number of rounds grows
with the logarithm of the longest path. Nothing but one row of sums per round reaches
the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkpul.llm.common import materialize


def _star(arcs: DataFrame, larger: bool) -> DataFrame:
    """Hang the neighbours ``v`` of each ``u`` on the least of ``u`` and its neighbours."""
    least = arcs.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    hung = arcs.join(least, "u")
    if larger:
        return hung.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return hung.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
        least.where("u <> m").select("u", F.col("m").alias("v"))
    )


def components(edges: DataFrame) -> DataFrame:
    """``u, v``: every node of ``edges`` (columns ``u, v``) that is not the least of its
    component, with that least node. Loops and repeated edges do no harm."""
    now = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    now, before = materialize(now, "edges"), None
    while True:
        state = now.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if state == before or state[0] == 0:
            return now
        before = state
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        now = materialize(_star(_star(both, True).distinct(), False).distinct(), "edges")
