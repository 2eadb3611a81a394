"""Exact kNN join by a quantised filter (J2, J3, T3), the plan for large references.

Every vector is also kept as two bytes a dimension (its cell in 65,536 equal steps over
twice the range of the reference in the dimension) with its exact distance to the centre
of its cells. Two such rows have a distance of ``|c(q) - c(r)|`` give or take both of
these residuals, so the codes alone give a lower and an upper bound, and these are so close
that hardly a row more than the k nearest needs its exact distance.

1. Cells of space. Up to ``PIVOTS`` reference rows, first by a hash of the id, are pivots;
   a reference row belongs to its nearest one, which knows its number of rows and its radius.
   From its distances to the pivots a query knows how far its k-th neighbour can be at most
   and leaves out every pivot whose rows all lie beyond: those rows never meet.
2. Tiles. The rest meet tile by tile as codes, a quarter of the vectors. A reference tile is
   a lane of several cells, worked through step by step, so that a query has few tiles: per
   query and tile the rows stay whose lower bound is within the k-th least upper bound of
   the tile, and these are what the shuffle to the next step grows with.
3. Over all tiles of a query the k-th least upper bound decides again.
4. Only the survivors are joined with their vectors; their exact distances, computed as in
   the other plans, give the same rows: order by distance rounded to 9 digits, then id.

Of reference rows with one and the same vector only the k least ids can be neighbours; the
others go first (Spark limits such groups before the shuffle), so a vector that a third of
the reference shares does not multiply. Otherwise nothing is capped: where vectors crowd
within the residuals, more survivors are compared.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import materialize
from .near import near_pairs

PIVOTS = 256
STEPS = 1 << 16
#: tiles that a side is cut into at most, as long as a tile may grow
MOST_TILES = 32
#: steps of ``small`` reference rows that a tile holds; a query tile is the same part of a step
LANE_STEPS = 8
#: cells of a tile at most, one bit each in a query's mask
LANE_CELLS = 31
#: room for distances that are equal after rounding to 9 digits
TIE = 2e-9


def tile_rows(asked: int, rows: int, most: int) -> int:
    """Rows of a tile of a side of ``rows``: as asked, or more for ``MOST_TILES`` tiles, at most ``most``."""
    return max(1, min(most, max(asked, math.ceil(rows / MOST_TILES))))


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False).reshape(len(column), dim)


def _code_matrix(column: pa.ChunkedArray, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(len(column), dim)


class Grid:
    """The steps of each dimension, and bounds from them."""

    def __init__(self, low: np.ndarray, high: np.ndarray):
        self.low, self.width = low, np.where(high > low, (high - low) / STEPS, 1.0)

    def codes(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes of each row and its distance to the centre of its cells."""
        code = np.clip(np.floor((x - self.low) / self.width), 0, STEPS - 1).astype(np.uint16)
        gap = x - self.centres(code)
        # rounded up, so that the bounds hold
        return code, np.sqrt(np.einsum("ij,ij->i", gap, gap)) * (1 + 1e-12)

    def centres(self, code: np.ndarray) -> np.ndarray:
        return self.low + (code + 0.5) * self.width

    def pair_bounds(self, between: np.ndarray, gaps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Lower and upper bound of the distances of rows, from the differences of their centres."""
        d = np.sqrt(np.einsum("ij,ij->i", between, between))
        # the sum's rounding, and that of a difference of far centres
        error = d * (1e-12 + between.shape[1] * np.finfo(float).eps) + TIE
        return np.maximum(d - gaps - error, 0), d + gaps + error

    def bounds(self, q: np.ndarray, q_gap: np.ndarray, r: np.ndarray, r_gap: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Lower and upper bound of every distance of rows given as codes."""
        a, b = self.centres(q), self.centres(r)
        middle = b.mean(axis=0)
        a, b = a - middle, b - middle
        aa, bb = np.einsum("ij,ij->i", a, a), np.einsum("ij,ij->i", b, b)
        d2 = aa[:, None] + bb[None, :] - 2.0 * (a @ b.T)
        error = 4 * (a.shape[1] + 4) * np.finfo(float).eps * (aa[:, None] + bb.max())
        room = q_gap[:, None] + r_gap[None, :] + TIE
        lower = np.sqrt(np.maximum(d2 - error, 0)) - room
        return np.maximum(lower, 0), np.sqrt(np.maximum(d2 + error, 0)) + room


def _ranges(refd: DataFrame, dim: int) -> Grid:
    """Twice the range of each dimension: one row per dimension reaches the driver."""

    def run(batches):
        low, high = np.full(dim, np.inf), np.full(dim, -np.inf)
        for b in batches:
            if b.num_rows:
                x = _matrix(b.column(0), dim)
                low, high = np.minimum(low, x.min(axis=0)), np.maximum(high, x.max(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(range(dim), pa.int32()), pa.array(low), pa.array(high)], ["i", "low", "high"])

    found = refd.select("_rv").mapInArrow(run, "i int, low double, high double").groupBy("i").agg(F.min("low"), F.max("high"))
    rows = sorted(found.collect())
    low, high = np.array([r[1] for r in rows]), np.array([r[2] for r in rows])
    # queries may lie outside; one beyond the grid has a large residual and loose bounds
    return Grid(low - (high - low) / 2, high + (high - low) / 2)


def _distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Distances of rows to the pivots, by difference."""
    return np.sqrt(np.stack([np.einsum("ij,ij->i", x - p, x - p) for p in pivots], axis=1))


def _coded(df: DataFrame, vec: str, grid: Grid, dim: int, extra, fields: list[T.StructField]) -> DataFrame:
    """``df`` without ``vec`` but with ``code``, ``gap`` and what ``extra`` makes of the vectors."""
    kept = [f for f in df.schema if f.name != vec]
    schema = T.StructType([*kept, T.StructField("code", T.BinaryType()), T.StructField("gap", T.DoubleType()), *fields])

    def run(batches):
        for b in batches:
            x = _matrix(b.column(b.schema.get_field_index(vec)), dim)
            code, gap = grid.codes(x)
            more = extra(x) if len(x) else [pa.array([], f_type) for f_type in empty]
            columns = [b.column(f.name) for f in kept]
            columns += [pa.array([c.tobytes() for c in code], pa.binary()), pa.array(gap), *more]
            yield pa.RecordBatch.from_arrays(columns, [f.name for f in schema])

    empty = [pa.list_(pa.int64()) if isinstance(f.dataType, T.ArrayType) else pa.int32() if f.name == "cell" else pa.float64() for f in fields]
    return df.mapInArrow(run, schema)


def _encode_reference(refd: DataFrame, grid: Grid, dim: int, pivots: np.ndarray) -> DataFrame:
    def extra(x):
        d = _distances(x, pivots)
        cell = d.argmin(axis=1)
        return [pa.array(cell, pa.int32()), pa.array(d[np.arange(len(x)), cell])]

    return _coded(refd.select("uid", "_rv"), "_rv", grid, dim, extra,
                  [T.StructField("cell", T.IntegerType()), T.StructField("away", T.DoubleType())])


def _lanes(sizes: np.ndarray, pivots: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Lane of every cell and its place there: cells that follow each other along the widest
    dimension, ``rows`` rows and ``LANE_CELLS`` cells at most (a cell of more rows is a lane)."""
    lane, place = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
    now = held = cells = 0
    for c in np.argsort(pivots[:, np.ptp(pivots, axis=0).argmax()], kind="stable"):
        if cells and (held + sizes[c] > rows or cells == LANE_CELLS):
            now, held, cells = now + 1, 0, 0
        lane[c], place[c] = now, cells
        held, cells = held + sizes[c], cells + 1
    return lane, place


def _encode_queries(
    qd: DataFrame, grid: Grid, dim: int, pivots: np.ndarray, sizes: np.ndarray, radii: np.ndarray, k: int,
    lane: np.ndarray, place: np.ndarray,
) -> DataFrame:
    """Queries with the cells that can hold one of their k nearest rows: a number per lane,
    the lane above 32 bits that mark its cells by their place."""

    def extra(x):
        d = _distances(x, pivots)
        far = d + radii
        order = np.argsort(far, axis=1, kind="stable")
        enough = np.cumsum(sizes[order], axis=1) >= k
        reach = np.take_along_axis(far, np.take_along_axis(order, enough.argmax(axis=1)[:, None], 1), 1)
        # rounding of three distances, and ties
        near = (d - radii <= reach * (1 + 1e-12) + TIE) & (sizes > 0)
        marks = near * (np.int64(1) << place)
        masks = np.stack([marks[:, lane == i].sum(axis=1) for i in range(lane.max() + 1)], axis=1)
        rows, lanes = np.nonzero(masks)
        ends = np.searchsorted(rows, np.arange(len(x) + 1)).astype(np.int32)
        return [pa.ListArray.from_arrays(pa.array(ends), pa.array(lanes << 32 | masks[rows, lanes], pa.int64()))]

    return _coded(qd, "_qv", grid, dim, extra, [T.StructField("asked", T.ArrayType(T.LongType()))])


def _within_reach(pairs: list[np.ndarray], queries: int, k: int) -> tuple[list[np.ndarray], np.ndarray]:
    """Pairs (query, row, lower, upper) whose lower bound is within the query's k-th least
    upper bound, and these bounds; a query with fewer than k pairs keeps all."""
    order = np.lexsort((pairs[3], pairs[0]))
    pairs = [x[order] for x in pairs]
    rows, _, lower, upper = pairs
    start, end = (np.searchsorted(rows, np.arange(queries), side) for side in ("left", "right"))
    reach = np.full(queries, np.inf)
    full = end - start >= k
    reach[full] = upper[start[full] + k - 1]
    kept = lower <= reach[rows]
    return [x[kept] for x in pairs], reach


def _count_map(counts: dict[int, int]):
    return F.create_map(*[x for c, n in sorted(counts.items()) for x in (F.lit(c), F.lit(n))])


def candidates(
    qd: DataFrame, refd: DataFrame, k: int, n_ref: int, dim: int, small: int, most: int = 1 << 15
) -> tuple[DataFrame, DataFrame]:
    """``_qid, uid, lower, upper`` of the pairs whose exact distance is needed, and the
    reference (``uid, _rid, _rv`` and carried columns) that ``uid`` belongs to."""
    same = Window.partitionBy("_rv").orderBy("_rid")
    least = refd.withColumn("_n", F.row_number().over(same)).where(F.col("_n") <= k).drop("_n")
    ref = materialize(least.withColumn("uid", F.monotonically_increasing_id()), "knn-reference")
    grid = _ranges(ref, dim)
    # no more cells than the reference needs tiles, or queries would meet mere scraps
    r_rows = tile_rows(small, n_ref, most)
    many = min(PIVOTS, max(1, math.ceil(n_ref / r_rows)))
    first = ref.orderBy(F.xxhash64("_rid"), "uid").select("_rv").limit(many).collect()
    pivots = np.array([r["_rv"] for r in first], dtype=np.float64).reshape(len(first), dim)
    coded = materialize(_encode_reference(ref, grid, dim, pivots), "knn-codes")
    # a row per pivot
    told = {r["cell"]: (r["n"], r["r"]) for r in coded.groupBy("cell").agg(F.count("*").alias("n"), F.max("away").alias("r")).collect()}
    sizes = np.array([told.get(c, (0, 0.0))[0] for c in range(len(pivots))])
    radii = np.array([told.get(c, (0, 0.0))[1] for c in range(len(pivots))])
    lane, place = _lanes(sizes, pivots, LANE_STEPS * r_rows)
    queries = materialize(_encode_queries(qd, grid, dim, pivots, sizes, radii, k, lane, place), "knn-queries")
    asked = queries.select("_qid", "code", "gap", F.explode("asked").alias("_asked")).select(
        "_qid", "code", "gap", F.shiftright("_asked", 32).cast("int").alias("lane"),
        F.col("_asked").bitwiseAND(F.lit((1 << 32) - 1)).cast("int").alias("mask"),
    )
    meets = {r["lane"]: r["count"] for r in asked.groupBy("lane").count().collect()}
    q_rows = tile_rows(max(1, small // LANE_STEPS), max(meets.values(), default=0), most)
    rows = {i: int(sizes[lane == i].sum()) for i in range(int(lane.max()) + 1)}
    r_tiles = {i: max(1, math.ceil(n / (LANE_STEPS * r_rows))) for i, n in rows.items()}
    q_tiles = {i: max(1, math.ceil(meets.get(i, 0) / q_rows)) for i in rows}

    def dealt(df, own, own_key, own_tiles, other, other_tiles):
        of = lambda tiles: F.element_at(_count_map(tiles), F.col("lane"))
        return df.withColumn(own, F.pmod(F.xxhash64(own_key), of(own_tiles).cast("long")).cast("int")).withColumn(
            other, F.explode(F.sequence(F.lit(0), of(other_tiles) - 1))
        )

    q_side = dealt(asked, "_qt", "_qid", q_tiles, "_rt", r_tiles)
    of_cell = F.element_at(_count_map({c: int(lane[c]) for c in told}), F.col("cell"))
    laned = coded.withColumn("lane", of_cell).where(F.col("lane").isin(list(meets))).drop("away")
    r_side = dealt(laned, "_rt", "uid", r_tiles, "_qt", q_tiles)
    schema = T.StructType([qd.schema["_qid"]]).add("uid", T.LongType()).add("lower", T.DoubleType()).add("upper", T.DoubleType())

    def meet(q: pa.Table, r: pa.Table) -> pa.Table:
        names = ["_qid", "uid", "lower", "upper"]
        if not q.num_rows or not r.num_rows:
            return pa.table([q.column("_qid")[:0], pa.array([], pa.int64()), *[pa.array([], pa.float64())] * 2], names)
        r_code, r_gap, cell = _code_matrix(r.column("code"), dim), r.column("gap").to_numpy(), r.column("cell").to_numpy()
        q_gap, mask = q.column("gap").to_numpy(), q.column("mask").to_numpy()
        q_mid = grid.centres(_code_matrix(q.column("code"), dim))
        # pairs so far, and per query the k-th least upper bound among them
        best, reach = [np.zeros(0, np.int64)] * 2 + [np.zeros(0)] * 2, np.full(len(q_mid), np.inf)
        for c in np.unique(cell):
            own, asks = np.flatnonzero(cell == c), np.flatnonzero(mask >> place[c] & 1)
            for at in range(0, len(own), r_rows):
                part = own[at : at + r_rows]
                r_mid, gaps = grid.centres(r_code[part]), q_gap[asks] + r_gap[part].max() + TIE
                # a bound of the k-th distance and a lower bound differ from the distance of the centres by so much
                within = (reach[asks] + gaps) * (1 + 1e-9) + TIE
                found = [best]
                for i, j in near_pairs(q_mid[asks], r_mid, k, 2 * gaps, within=within):
                    rows, cols = asks[i], part[j]
                    found.append((rows, cols, *grid.pair_bounds(q_mid[rows] - r_mid[j], q_gap[rows] + r_gap[cols])))
                best, reach = _within_reach([np.concatenate(x) for x in zip(*found, strict=True)], len(q_mid), k)
        rows, cols, low, high = best
        ids = r.column("uid").to_numpy()[cols]
        return pa.table([q.column("_qid").take(pa.array(rows)), pa.array(ids), pa.array(low), pa.array(high)], names)

    keys = ["lane", "_qt", "_rt"]
    met = q_side.groupBy(*keys).cogroup(r_side.groupBy(*keys)).applyInArrow(meet, schema)
    by_upper = Window.partitionBy("_qid").orderBy("upper", "uid")
    ranked = met.withColumn("_n", F.row_number().over(by_upper))
    kth = F.max(F.when(F.col("_n") == k, F.col("upper"))).over(Window.partitionBy("_qid"))
    left = ranked.withColumn("_reach", kth).where(F.col("lower") <= F.coalesce("_reach", F.lit(math.inf)))
    return left.drop("_n", "_reach"), ref


def knn_quantised(
    qd: DataFrame, refd: DataFrame, k: int, query_id: str, carry: list, n_ref: int, dim: int, small: int, most: int
) -> DataFrame:
    """The k nearest reference rows of every query, as the other plans return them."""
    left, ref = candidates(qd, refd, k, n_ref, dim, small, most)
    left = materialize(left.select("_qid", "uid"), "knn-candidates")
    # a reference row near very many queries is split by AQE
    pairs = left.join(ref, "uid").join(qd.select("_qid", "_qv"), "_qid")
    kept = [f for f in pairs.select("_qid", "_rid", *[f"_c_{c}" for c in carry]).schema]

    def exact(batches):
        for b in batches:
            gap = _matrix(b.column("_qv"), dim) - _matrix(b.column("_rv"), dim)
            columns = [*[b.column(f.name) for f in kept], pa.array(np.sqrt(np.einsum("ij,ij->i", gap, gap)))]
            yield pa.RecordBatch.from_arrays(columns, [*[f.name for f in kept], "_d"])

    found = pairs.mapInArrow(exact, T.StructType([*kept, T.StructField("_d", T.DoubleType())]))
    best = Window.partitionBy("_qid").orderBy(F.round("_d", 9), F.col("_rid"))
    return (
        found.withColumn("nn_rank", F.row_number().over(best).cast("int"))
        .where(F.col("nn_rank") <= k)
        .select(
            F.col("_qid").alias(query_id), F.col("_rid").alias("nn_id"), F.col("_d").alias("distance"), "nn_rank",
            *[F.col(f"_c_{c}").alias(c) for c in carry],
        )
    )
