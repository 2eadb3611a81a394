"""Random forests of many rows (M14), grown by the tasks.

The rules are those of MLlib's forest: 32 bins a feature, rows drawn by Poisson(1) counts, a
draw of ``ceil(sqrt(features))`` features a node, the split of largest Gini gain, leaves where
no gain is left, rows of one class or the greatest depth is reached, and sibling leaves of one
prediction merged. What differs is who works:

1. Bins. A task sums up each feature of a block by at most ``SUMMARY`` weighted values; the
   merged summaries give the cuts. Rows are kept as blocks of one byte a feature.
2. Tops. A node of more than ``LOCAL_VALUES`` bytes is split by histograms that all tasks add
   up, a pass a level for all trees; the driver holds these nodes alone.
3. Subtrees. The rows of every other node meet in one task, which grows all below it level by
   level, and are shuffled once however deep it gets. The trees are a table of one row a
   subtree; they never reach the driver.
4. Rows to predict go down the tops, meet the subtrees, and their votes are averaged.

A row's count in a tree depends on the seed, the tree and the block, and the features of a node
on the seed and its place, so the order of the rows in a shuffle changes nothing.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .blocks import add_up, pack, unpack

MAX_BINS = 32
#: classes that MLlib infers from labels at most
MOST_CLASSES = 100
#: weighted values that a feature of a block is summed up by
SUMMARY = 1024
#: bytes of the binned rows of a node that one task grows a subtree from
LOCAL_VALUES = 1 << 25
#: bytes of histograms that a task holds; more trees take turns
STATS_BYTES = 64 << 20
#: histogram cells that are worked on at once
CELLS = 1 << 18
#: tasks that subtrees are dealt to at most
MOST_TASKS = 1024
#: leaves' shares are multiples of this, so that sums of votes do not depend on their order
SHARE = 2.0**-40


@dataclass
class Tree:
    """Nodes of a tree, the root first: ``feature`` -1 is a leaf; rows with a bin up to ``cut``
    go to ``left``, the others to the node after it. ``counts`` are drawn rows by class."""

    feature: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    counts: np.ndarray

    def leaves(self, x: np.ndarray) -> np.ndarray:
        """The leaf of every row."""
        return _leaves(self.feature, self.cut, self.left, x)

    def prune(self, told: np.ndarray | None = None) -> None:
        """Merge sibling leaves of one prediction, as long as there are any. A leaf whose
        ``told`` is -1 stays, as more is below it."""
        told = self.counts.argmax(axis=1) if told is None else told.copy()
        inner = np.flatnonzero(self.feature >= 0)
        told[inner] = -1
        same = np.ones(1, bool)
        while same.any():
            one, other = told[self.left[inner]], told[self.left[inner] + 1]
            same = (one == other) & (one != -1)
            merged, inner = inner[same], inner[~same]
            self.feature[merged], told[merged] = -1, self.counts[merged].argmax(axis=1)

    def levels(self) -> np.ndarray:
        """Level of every node."""
        at = np.zeros(len(self.feature), np.int64)
        for i in np.flatnonzero(self.feature >= 0):
            at[self.left[i] : self.left[i] + 2] = at[i] + 1
        return at


def _leaves(feature: np.ndarray, cut: np.ndarray, left: np.ndarray, x: np.ndarray) -> np.ndarray:
    at = np.zeros(len(x), np.int32)
    going = np.arange(len(x)) if feature[0] >= 0 else np.zeros(0, np.int64)
    while len(going):
        now = at[going]
        at[going] = now = left[now] + (x[going, feature[now]] > cut[now])
        going = going[feature[now] >= 0]
    return at


def _share(counts: np.ndarray) -> np.ndarray:
    """Share of class 1 in a leaf."""
    return np.rint(counts[:, 1] / np.maximum(counts.sum(axis=1), 1) / SHARE) * SHARE


def best_splits(
    x: np.ndarray, y: np.ndarray, w: np.ndarray, node: np.ndarray, counts: np.ndarray, bins: int, draw: int, rng: np.random.Generator
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Feature (-1: no gain), cut and left counts of each node; rows are sorted by ``node``."""
    feature, cut, left = np.full(len(counts), -1), np.zeros(len(counts), np.int64), np.zeros_like(counts)
    step = max(1, CELLS // (bins * counts.shape[1]))
    for at in range(0, len(counts), step):
        part = slice(at, min(len(counts), at + step))
        rows = slice(*np.searchsorted(node, [part.start, part.stop]))
        asked = draws(rng, part.stop - part.start, x.shape[1], draw)
        own = x[rows], y[rows], w[rows], node[rows] - at
        found = _best_of(asked, counts[part], (_counted(*own, f, bins, counts.shape[1]) for f in asked.T))
        feature[part], cut[part], left[part] = found
    return feature, cut, left


def draws(rng: np.random.Generator, nodes: int, dim: int, draw: int) -> np.ndarray:
    """``draw`` different features for each node."""
    if draw >= dim:
        return np.tile(np.arange(dim), (nodes, 1))
    return rng.random((nodes, dim), np.float32).argpartition(draw - 1, axis=1)[:, :draw]


def _counted(x, y, w, node, feature, bins: int, classes: int) -> np.ndarray:
    """Drawn rows by class, node and bin of the node's feature."""
    nodes = len(feature)
    b = x.ravel()[np.arange(0, x.size, x.shape[1]) + feature[node]]
    return np.bincount((y * nodes + node) * bins + b, w, classes * nodes * bins).reshape(classes, nodes, bins)


def _best_of(asked: np.ndarray, counts: np.ndarray, counted: Iterable[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The best split of every node; ``counted`` has the counts of one feature asked after the other."""
    nodes, classes = counts.shape
    total, each = counts.sum(axis=1)[:, None], np.arange(nodes)
    best, feature, cut, left = np.zeros(nodes), np.full(nodes, -1), np.zeros(nodes, np.int64), np.zeros_like(counts)
    for s, found in enumerate(counted):
        below = found.cumsum(axis=2)
        n = below.sum(axis=0)
        # the gain times a number of the node: a class's count below against its share of all,
        # differences of whole numbers, so that no gain is exactly 0
        score = 0.0
        for c in range(1 if classes == 2 else 0, classes):
            off = below[c] * total - counts[:, c : c + 1] * n
            score = score + off * off
        score = score / np.maximum(n * (total - n), 1)
        at = score.argmax(axis=1)
        here = score[each, at]
        better = np.flatnonzero(here > best)
        best[better], feature[better], cut[better] = here[better], asked[better, s], at[better]
        left[better] = below[:, better, at[better]].T
    return feature, cut, left


def grow_subtree(
    x: np.ndarray, y: np.ndarray, w: np.ndarray, classes: int, depth: int, bins: int, draw: int, rng: np.random.Generator
) -> Tree:
    """The whole tree of binned rows ``x`` with labels ``y`` and counts ``w``, ``depth`` levels at most."""
    counts = np.bincount(y, w, classes)[None, :]
    node, first, levels = np.zeros(len(x), np.int64), 0, []
    for level in range(depth + 1):
        feature, cut, left = np.full(len(counts), -1, np.int32), np.zeros(len(counts), np.uint8), np.zeros(len(counts), np.int32)
        levels.append((feature, cut, left, counts))
        going = np.flatnonzero((counts > 0).sum(axis=1) > 1)
        if level == depth or not len(going):
            break
        place = np.full(len(counts), -1)
        place[going] = np.arange(len(going))
        held = place[node] >= 0
        x, y, w, node = x[held], y[held], w[held], place[node[held]]
        f, c, below = best_splits(x, y, w, node, counts[going], bins, draw, rng)
        split = np.flatnonzero(f >= 0)
        feature[going[split]], cut[going[split]] = f[split], c[split]
        first += len(counts)
        left[going[split]] = first + 2 * np.arange(len(split))
        child = np.full(len(going), -1)
        child[split] = 2 * np.arange(len(split))
        counts = np.stack([below[split], counts[going[split]] - below[split]], axis=1).reshape(-1, classes)
        held = np.flatnonzero(child[node] >= 0)
        at = node[held]
        to = child[at] + (x.ravel()[held * x.shape[1] + f[at]] > c[at])
        order = np.argsort(to, kind="stable")
        x, y, w, node = x[held[order]], y[held[order]], w[held[order]], to[order]
        if not len(split):
            break
    tree = Tree(*[np.concatenate(v) for v in zip(*levels, strict=True)])
    tree.prune()
    return tree


def summed_up(values: np.ndarray, weights: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values and their weights, at most ``most`` of them: those in the middle of equal shares."""
    order = np.argsort(values, kind="stable")
    values, weights = values[order], weights[order]
    starts = np.flatnonzero(np.r_[True, values[1:] != values[:-1]])
    values, weights = values[starts], np.add.reduceat(weights, starts)
    if len(values) > most:
        ends = weights.cumsum()
        values = values[np.searchsorted(ends, (np.arange(most) + 0.5) * (ends[-1] / most))]
        starts = np.flatnonzero(np.r_[True, values[1:] != values[:-1]])
        values, weights = values[starts], np.diff(np.r_[starts, most]) * (ends[-1] / most)
    return values, weights


def cuts(values: np.ndarray, weights: np.ndarray, most: int) -> np.ndarray:
    """Up to ``most`` cuts between distinct values: all, or those nearest to equal shares (MLlib's rule)."""
    middle = (values[1:] + values[:-1]) / 2
    if len(middle) <= most:
        return middle
    ends, share = weights.cumsum(), weights.sum() / (most + 1)
    found, target = [], share
    for i in range(1, len(values)):
        if abs(ends[i - 1] - target) < abs(ends[i] - target):
            found.append(middle[i - 1])
            target += share
    return np.array(found[:most])


def _features(col: str, dim: int, finite: bool) -> Column:
    """The vector, or an error for what MLlib refuses too."""
    v = F.col(col).cast("array<double>")
    bad = F.coalesce(F.size(v) != dim, F.lit(True)) | F.exists(v, lambda x: x.isNull())
    if finite:
        bad = bad | F.exists(v, lambda x: F.isnan(x) | (F.abs(x) == math.inf))
    message = F.lit(f"vectors need {dim} numbers, neither null nor infinite")
    return F.when(F.coalesce(~bad, F.lit(False)), v).otherwise(F.raise_error(message))


def _label(col: str) -> Column:
    y = F.col(col).cast("double")
    good = (y >= 0) & (y < MOST_CLASSES) & (y == F.floor(y))
    return F.when(F.coalesce(good, F.lit(False)), y).otherwise(F.raise_error(F.lit(f"labels are whole numbers from 0 to {MOST_CLASSES - 1}")))


def _cuts(blocks: DataFrame, dim: int) -> tuple[list[np.ndarray], int]:
    """Cuts of each feature, and the number of classes: one row per feature reaches the driver."""
    lanes = max(1, math.ceil(math.sqrt(blocks.rdd.getNumPartitions())))
    schema = "feature int, lane int, vals binary, weights binary"

    def batch_of(features: list[int], lane: int, sums: list[tuple]) -> pa.RecordBatch:
        data = [pa.array(features, pa.int32()), pa.array([lane] * len(features), pa.int32())]
        data += [pa.array([a.tobytes() for a in column], pa.binary()) for column in zip(*sums, strict=True)]
        return pa.RecordBatch.from_arrays(data, ["feature", "lane", "vals", "weights"])

    def told(batches):
        lane = TaskContext.get().partitionId() % lanes
        for batch in batches:
            for n, x, y in unpack(batch, ["x", "y"]):
                # the labels are summed up like a feature after the last
                columns = [*x.T, y[:, 0]]
                yield batch_of([*range(dim + 1)], lane, [summed_up(c, np.ones(n), SUMMARY) for c in columns])

    def merged(table: pa.Table) -> pa.Table:
        both = summed_up(_joined(table, "vals", np.float64), _joined(table, "weights", np.float64), SUMMARY)
        return pa.Table.from_batches([batch_of([table.column("feature")[0].as_py()], table.column("lane")[0].as_py(), [both])])

    parts = blocks.select("n", "x", "y").mapInArrow(told, schema).groupBy("feature", "lane").applyInArrow(merged, schema)
    whole = {r["feature"]: r for r in parts.groupBy("feature").applyInArrow(merged, schema).collect()}
    summary = [[np.frombuffer(whole[f][c], np.float64) for c in ("vals", "weights")] for f in range(dim + 1)]
    return [cuts(v, w, MAX_BINS - 1) for v, w in summary[:dim]], max(2, int(summary[dim][0].max()) + 1)


def _binned(blocks: DataFrame, found: list[np.ndarray], other: str, kind: type) -> DataFrame:
    """Blocks of one byte a feature, numbered; ``other`` is a further column of one number a row."""

    def run(batches):
        for batch in batches:
            for n, x, more in unpack(batch, ["x", other]):
                b = np.stack([np.searchsorted(c, x[:, f]) for f, c in enumerate(found)], axis=1).astype(np.uint8)
                data = [pa.array([n], pa.int32()), pa.array([b.tobytes()]), pa.array([more[:, 0].astype(kind).tobytes()])]
                yield pa.RecordBatch.from_arrays(data, ["n", "x", other])

    codes = blocks.select("n", "x", other).mapInArrow(run, f"n int, x binary, {other} binary")
    return materialize(codes.withColumn("block", F.monotonically_increasing_id()), "forest-bins")


def _read(batch: pa.RecordBatch, other: str, kind: type) -> Iterator[tuple]:
    """Number, rows and further column of each block of a batch."""
    for i in range(batch.num_rows):
        n = batch.column("n")[i].as_py()
        x = np.frombuffer(batch.column("x")[i].as_buffer(), np.uint8).reshape(n, -1)
        yield batch.column("block")[i].as_py(), x, np.frombuffer(batch.column(other)[i].as_buffer(), kind)


def _joined(table: pa.Table, name: str, kind: type) -> np.ndarray:
    return np.concatenate([np.frombuffer(b.as_buffer(), kind) for b in table.column(name)])


@dataclass
class Forest:
    """Tops on the driver, a table of subtrees by ``part`` (a tree's top leaf), and the cuts."""

    tops: list[Tree]
    parts: list[dict[int, int]]
    subtrees: DataFrame
    found: list[np.ndarray] = field(repr=False)

    def predict(self, df: DataFrame, features: str, out: str) -> DataFrame:
        """``df`` with the mean share of class 1 in the leaves of each row."""
        rows = materialize(df.withColumn("_uid", F.monotonically_increasing_id()), "forest-asked")
        dim = len(self.found)
        blocks = pack(rows, {"x": _features(features, dim, False), "uid": F.array(F.col("_uid"))})
        asked = _binned(blocks, self.found, "uid", np.int64)
        tops, parts = self.tops, self.parts
        many = sum(map(len, parts))
        # a subtree meets all rows of a tile that fall in it
        values = asked.agg(F.sum(F.col("n").cast("long"))).first()[0] or 0
        tiles = max(1, math.ceil(values * dim * len(tops) / (many * LOCAL_VALUES)))

        def down(batches):
            for batch in batches:
                for block, x, uid in _read(batch, "uid", np.int64):
                    for top, part in zip(tops, parts, strict=True):
                        leaf = top.leaves(x)
                        for i in np.unique(leaf):
                            mine = np.flatnonzero(leaf == i)
                            data = [part[int(i)]], [block % tiles], [x[mine].tobytes()], [uid[mine].tobytes()]
                            yield pa.RecordBatch.from_arrays(
                                [pa.array(v, t) for v, t in zip(data, (pa.int32(), pa.int32(), pa.binary(), pa.binary()), strict=True)],
                                ["part", "tile", "x", "uid"],
                            )

        def vote(trees: pa.Table, q: pa.Table) -> pa.Table:
            if not q.num_rows:
                return pa.table({"_uid": pa.array([], pa.int64()), "_share": pa.array([], pa.float64())})
            feature, cut, left, share = (_joined(trees, n, t) for n, t in SUBTREE.items())
            at = _leaves(feature, cut, left, _joined(q, "x", np.uint8).reshape(-1, dim))
            return pa.table({"_uid": pa.array(_joined(q, "uid", np.int64)), "_share": pa.array(share[left[at]])})

        n = min(MOST_TASKS, many * tiles)
        told = asked.mapInArrow(down, "part int, tile int, x binary, uid binary").repartition(n, "part", "tile").groupBy("part", "tile")
        trees = self.subtrees.withColumn("tile", F.explode(F.sequence(F.lit(0), F.lit(tiles - 1)))).repartition(n, "part", "tile")
        votes = trees.groupBy("part", "tile").cogroup(told).applyInArrow(vote, "_uid long, _share double")
        mean = votes.groupBy("_uid").agg((F.sum("_share") / len(tops)).alias(out))
        return rows.join(mean, "_uid", "left").select(*df.columns, out)


#: arrays of a subtree's row; ``left`` of a leaf is the place of its share
SUBTREE = {"feature": np.int32, "cut": np.uint8, "left": np.int32, "share": np.float64}
SUBTREE_SCHEMA = "part int, nodes int, told int, feature binary, cut binary, left binary, share binary"


def _row_of(part: int, tree: Tree) -> list:
    leaf = tree.feature < 0
    left = tree.left.copy()
    left[leaf] = np.arange(leaf.sum())
    told = int(tree.counts[0].argmax()) if tree.feature[0] < 0 else -1
    arrays = tree.feature, tree.cut, left, _share(tree.counts[leaf])
    return [part, len(leaf), told, *[a.astype(t).tobytes() for a, t in zip(arrays, SUBTREE.values(), strict=True)]]


def _grow_tops(rows: DataFrame, trees: int, classes: int, depth: int, bins: int, draw: int, dim: int, seed: int, drawn) -> list[Tree]:
    """The trees down to nodes that a task can hold, all trees level by level."""
    tasks = rows.rdd.getNumPartitions()

    def added_up(count, of: dict, size: int) -> dict[int, np.ndarray]:
        """Sums of ``count(tree, x, y, w)`` over the blocks, by tree; ``of`` are the trees."""

        def run(batches):
            total = dict.fromkeys(of, 0.0)
            for batch in batches:
                for block, x, y in _read(batch, "y", np.uint8):
                    for tree in of:
                        w = drawn(tree, block, len(x))
                        held = np.flatnonzero(w)
                        total[tree] = total[tree] + count(tree, x[held], y[held].astype(np.int64), w[held].astype(np.float64))
            seen = {t: v for t, v in total.items() if np.ndim(v)}
            yield pa.RecordBatch.from_arrays(
                [pa.array([*seen], pa.int32()), pa.array([v.tobytes() for v in seen.values()], pa.binary())], ["tree", "sums"]
            )

        return dict(add_up(rows.mapInArrow(run, "tree int, sums binary"), tasks, "tree", "sums", size * len(of)))

    roots = added_up(lambda tree, x, y, w: np.bincount(y, w, classes), dict.fromkeys(range(trees)), 8 * classes)
    tops = [Tree(np.full(1, -1), np.zeros(1, np.int64), np.zeros(1, np.int64), roots[t][None, :]) for t in range(trees)]
    for level in range(depth):
        asked = {}
        for tree, top in enumerate(tops):
            large = (top.feature < 0) & (top.levels() == level) & (top.counts.sum(axis=1) * dim > LOCAL_VALUES)
            nodes = np.flatnonzero(large & ((top.counts > 0).sum(axis=1) > 1))
            if len(nodes):
                asked[tree] = nodes, draws(np.random.default_rng([seed, 2, tree, level]), len(nodes), dim, draw)
        if not asked:
            break
        size = 8 * classes * bins * draw
        turn, turns = [], []
        for tree in asked:
            if turn and size * sum(len(asked[t][0]) for t in [*turn, tree]) > STATS_BYTES:
                turns, turn = [*turns, turn], []
            turn.append(tree)
        for turn in [*turns, turn]:

            def count(tree, x, y, w):
                nodes, features = asked[tree]  # noqa: B023
                place = np.full(len(tops[tree].feature), -1)
                place[nodes] = np.arange(len(nodes))
                at = place[tops[tree].leaves(x)]
                own = np.flatnonzero(at >= 0)
                return np.concatenate([_counted(x[own], y[own], w[own], at[own], f, bins, classes).ravel() for f in features.T])

            most = max(len(asked[t][0]) for t in turn)
            for tree, sums in added_up(count, {t: asked[t] for t in turn}, size * most).items():
                nodes, features = asked[tree]
                top = tops[tree]
                f, c, left = _best_of(features, top.counts[nodes], sums.reshape(draw, classes, len(nodes), bins))
                nodes, f, c, left = nodes[f >= 0], f[f >= 0], c[f >= 0], left[f >= 0]
                top.feature[nodes], top.cut[nodes], top.left[nodes] = f, c, len(top.feature) + 2 * np.arange(len(nodes))
                below = np.stack([left, top.counts[nodes] - left], axis=1).reshape(-1, classes)
                new = np.full(len(below), -1), np.zeros(len(below), np.int64), np.zeros(len(below), np.int64), below
                tops[tree] = Tree(*[np.concatenate(v) for v in zip((top.feature, top.cut, top.left, top.counts), new, strict=True)])
    return tops


def grow(df: DataFrame, label: str, features: str, trees: int, depth: int, seed: int) -> Forest:
    """A forest of ``trees`` trees of up to ``depth`` levels below the root."""
    spark = df.sparkSession
    head = df.where(F.col(features).isNotNull()).select(F.size(features)).first()
    if head is None:
        raise ValueError("no rows to fit")
    dim = head[0]
    blocks = pack(df, {"x": _features(features, dim, True), "y": F.array(_label(label))})
    found, classes = _cuts(blocks, dim)
    rows = _binned(blocks, found, "y", np.uint8)
    bins = max(map(len, found)) + 1
    draw = dim if trees == 1 else math.ceil(math.sqrt(dim))
    seed &= (1 << 64) - 1

    def drawn(tree: int, block: int, n: int) -> np.ndarray:
        return np.random.default_rng([seed, 0, tree, block]).poisson(1.0, n)

    tops = _grow_tops(rows, trees, classes, depth, bins, draw, dim, seed, drawn)
    # a part is a top leaf with rows to grow from; a leaf already final has none
    levels = [top.levels() for top in tops]
    growing = [[int(i) for i in np.flatnonzero(t.feature < 0) if at[i] < depth and (t.counts[i] > 0).sum() > 1] for t, at in zip(tops, levels, strict=True)]
    numbers = iter(range(1 << 31))
    parts = [{i: next(numbers) for i in nodes} for nodes in growing]
    places = {p: (tree, i, depth - int(levels[tree][i])) for tree, of in enumerate(parts) for i, p in of.items()}

    def down(batches):
        names = ["part", "x", "y", "w"]
        for batch in batches:
            for block, x, y in _read(batch, "y", np.uint8):
                for tree, (top, part) in enumerate(zip(tops, parts, strict=True)):
                    w = drawn(tree, block, len(x))
                    held = np.flatnonzero(w)
                    leaf = top.leaves(x[held])
                    for i in np.unique(leaf):
                        if int(i) in part:
                            mine = held[leaf == i]
                            data = [pa.array([v[mine].tobytes()]) for v in (x, y, w.astype(np.uint8))]
                            yield pa.RecordBatch.from_arrays([pa.array([part[int(i)]], pa.int32()), *data], names)

    def below(table: pa.Table) -> pa.Table:
        p = table.column("part")[0].as_py()
        tree, i, left = places[p]
        x, y, w = (_joined(table, n, np.uint8) for n in ("x", "y", "w"))
        got = grow_subtree(x.reshape(-1, dim), y.astype(np.int64), w.astype(np.float64), classes, left, bins, draw, np.random.default_rng([seed, 1, tree, i]))
        kinds = [pa.int32()] * 3 + [pa.binary()] * 4
        names = [c.split()[0] for c in SUBTREE_SCHEMA.split(", ")]
        return pa.table({n: pa.array([v], k) for n, v, k in zip(names, _row_of(p, got), kinds, strict=True)})

    dealt = rows.mapInArrow(down, "part int, x binary, y binary, w binary").repartition(max(1, min(MOST_TASKS, len(places))), "part")
    subtrees = materialize(dealt.groupBy("part").applyInArrow(below, SUBTREE_SCHEMA), "forest")
    # leaves of the tops: those that were final, and those that subtrees of one leaf leave
    single = {r["part"]: r["told"] for r in subtrees.where("nodes = 1").select("part", "told").collect()}
    final = []
    for tree, top in enumerate(tops):
        told = top.counts.argmax(axis=1)
        for i, p in parts[tree].items():
            told[i] = single.get(p, -1)
        top.prune(told)
        for i in [int(i) for i in np.flatnonzero(top.feature < 0) if i not in parts[tree]]:
            parts[tree][i] = next(numbers)
            final.append(_row_of(parts[tree][i], Tree(np.array([-1]), np.zeros(1), np.zeros(1, np.int32), top.counts[i : i + 1])))
    if final:
        subtrees = subtrees.unionByName(spark.createDataFrame(final, SUBTREE_SCHEMA))
    return Forest(tops, parts, subtrees, found)
