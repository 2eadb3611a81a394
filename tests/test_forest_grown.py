"""Forests of many rows, grown by the tasks: tops by histograms of all tasks, subtrees by one."""

import numpy as np
import pytest

from sparkpul.plans import base, forest
from sparkpul.plans.base import RandomForest


def rows(spark, n=600, dim=4, parts=5):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(n, dim))
    y = (x[:, 0] + 0.3 * rng.normal(size=n) > 0).astype(int)
    df = spark.createDataFrame([(i, x[i].tolist(), int(y[i])) for i in range(n)], "vec_id long, features array<double>, y int")
    return y, df.repartition(parts, "vec_id")


def plain(x, y, w, depth, bins):
    """(counts at the leaf, prediction) of every row, by a recursion over all cuts of all features."""
    counts = np.bincount(y, w, 2)
    n, best, at = counts.sum(), 0.0, None
    if depth and (counts > 0).all():
        for f in range(x.shape[1]):
            for cut in range(bins):
                low = x[:, f] <= cut
                m = w[low].sum()
                off = w[low & (y == 1)].sum() * n - counts[1] * m
                if 0 < m < n and off * off / (m * (n - m)) > best:
                    best, at = off * off / (m * (n - m)), (f, cut)
    if at is None:
        return [counts.tolist()] * len(x), int(counts.argmax())
    low = x[:, at[0]] <= at[1]
    (a, told_a), (b, told_b) = (plain(x[s], y[s], w[s], depth - 1, bins) for s in (low, ~low))
    if told_a is not None and told_a == told_b:
        return [counts.tolist()] * len(x), told_a
    out = np.empty(len(x), object)
    for s, leaves in ((low, a), (~low, b)):
        for i, leaf in zip(np.flatnonzero(s), leaves):
            out[i] = leaf
    return list(out), None


@pytest.mark.parametrize("depth", [2, 4, 30])
def test_subtree_against_plain_recursion(depth):
    rng = np.random.default_rng(depth)
    x = rng.integers(0, 6, (150, 3)).astype(np.uint8)
    y, w = (rng.random(150) < 0.2 + 0.1 * x[:, 0]).astype(np.int64), 1.0 + rng.poisson(1, 150)
    tree = forest.grow_subtree(x, y, w, 2, depth, 6, 3, np.random.default_rng(0))
    assert tree.counts[tree.leaves(x)].tolist() == plain(x, y, w, depth, 6)[0]
    assert tree.levels().max() <= depth


def test_cuts():
    few = np.array([0.0, 1.0, 5.0])
    assert forest.cuts(few, np.ones(3), 31).tolist() == [0.5, 3.0]
    many = forest.cuts(np.arange(320.0), np.ones(320), 31)
    assert len(many) == 31 and np.abs(np.diff(many) - 10).max() <= 1
    values, weights = forest.summed_up(np.repeat(np.arange(5000.0), 3), np.ones(15000), 1024)
    assert len(values) <= 1024 and weights.sum() == pytest.approx(15000)
    assert forest.summed_up(np.array([2.0, 1.0, 2.0]), np.ones(3), 9)[1].tolist() == [1, 2]


def test_tops_change_nothing(spark, monkeypatch):
    """One tree asks for all features, so where its top ends does not matter."""
    _, df = rows(spark)
    found = []
    for size in (1 << 25, 4 * 100, 1):
        monkeypatch.setattr(forest, "LOCAL_VALUES", size)
        grown = forest.grow(df, "y", "features", 1, 30, 7)
        found.append([r["p"] for r in grown.predict(df, "features", "p").orderBy("vec_id").collect()])
        assert (len(grown.tops[0].feature) == 1) == (size == 1 << 25)
    assert found[0] == found[1] == found[2]


def test_votes_are_the_mean_of_the_trees(spark, monkeypatch):
    y, df = rows(spark)
    monkeypatch.setattr(forest, "LOCAL_VALUES", 4 * 200)
    grown = forest.grow(df, "y", "features", 7, 5, 7)
    got = grown.predict(df, "features", "p").orderBy("vec_id").toPandas()
    assert list(got.columns) == ["vec_id", "features", "y", "p"]
    x = np.stack([np.searchsorted(c, np.stack(got["features"])[:, f]) for f, c in enumerate(grown.found)], axis=1).astype(np.uint8)
    trees = {r["part"]: [np.frombuffer(r[c], t) for c, t in forest.SUBTREE.items()] for r in grown.subtrees.collect()}
    votes = np.zeros(len(x))
    for top, part in zip(grown.tops, grown.parts):
        leaf = top.leaves(x)
        assert (top.levels() <= 5).all()
        for i in np.unique(leaf):
            feature, cut, left, share = trees[part[int(i)]]
            mine = leaf == i
            votes[mine] += share[left[forest._leaves(feature, cut, left, x[mine])]]
    assert np.allclose(got["p"], votes / 7, atol=1e-12)
    assert ((got["p"] > 0.5).astype(int) == y).mean() > 0.85


def test_large_forest_as_good_as_mllib(spark, monkeypatch):
    _, df = rows(spark, 1200)
    train, test = df.where("vec_id % 3 > 0"), df.where("vec_id % 3 = 0")
    right = {}
    for name, large in (("mllib", 20_000), ("grown", 100)):
        monkeypatch.setattr(base, "TREE_ROWS", 1 << 30 if name == "mllib" else 1000)
        monkeypatch.setattr(base, "LARGE_ROWS", large)
        model = RandomForest(num_trees=30, max_depth=30).fit(train, "y")
        assert isinstance(model, base._GrownForest) == (name == "grown")
        told = model.predict(test).collect()
        assert len(told) == 400
        right[name] = np.mean([r["prediction"] == r["y"] for r in told])
    assert abs(right["mllib"] - right["grown"]) < 0.05


def test_repeated_ids_null_ids_and_one_class(spark):
    _, df = rows(spark, 60)
    asked = df.selectExpr("if(vec_id % 2 = 0, null, 1) as vec_id", "features", "0 as y")
    got = forest.grow(asked, "y", "features", 3, 5, 1).predict(asked, "features", "p").collect()
    assert len(got) == 60 and {r["p"] for r in got} == {0.0}


@pytest.mark.parametrize("broken", ["null", "array(1D, 2D)", "array(1D, null, 1D, 1D)", "array(1D, double('nan'), 1D, 1D)"])
def test_broken_rows_fail(spark, broken):
    _, df = rows(spark, 60)
    bad = df.selectExpr("vec_id", f"if(vec_id = 9, {broken}, features) as features", "y")
    with pytest.raises(Exception, match="vectors need 4 numbers"):
        forest.grow(bad, "y", "features", 3, 5, 1)
    with pytest.raises(Exception, match="labels are whole numbers"):
        forest.grow(df.selectExpr("vec_id", "features", "if(vec_id = 9, null, y) as y"), "y", "features", 3, 5, 1)
