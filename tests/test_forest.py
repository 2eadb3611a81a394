"""A forest larger than one fit may be: grown and asked part by part."""

import numpy as np
from pyspark.ml.classification import RandomForestClassificationModel

from sparkpul.plans import base
from sparkpul.plans.base import RandomForest


def rows(spark, n=240):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(n, 4))
    y = (x[:, 0] + 0.3 * rng.normal(size=n) > 0).astype(int)
    return y, spark.createDataFrame([(i, x[i].tolist(), int(y[i])) for i in range(n)], "vec_id long, features array<double>, y int")


def test_forest_in_parts(spark, monkeypatch):
    y, df = rows(spark)
    monkeypatch.setattr(base, "TREE_ROWS", 3 * len(y))
    model = RandomForest(num_trees=7, max_depth=4).fit(df, "y")
    parts = [RandomForestClassificationModel.load(p) for p in model.paths]
    assert [p.getNumTrees for p in parts] == [3, 3, 1]
    got = model.predict_proba(df, out="p").orderBy("vec_id").toPandas()
    assert list(got.columns) == ["vec_id", "features", "y", "p"]
    votes = 0
    for p in parts:
        told = p.transform(df.select("vec_id", base._vec().alias("_vec"))).orderBy("vec_id")
        votes = votes + np.array([r["rawPrediction"].toArray() for r in told.collect()])
    assert np.allclose(got["p"], votes[:, 1] / votes.sum(axis=1), atol=1e-12)
    assert ((got["p"] > 0.5).astype(int) == y).mean() > 0.85


def test_trees_stay_off_the_tasks(spark):
    _, df = rows(spark)
    assert RandomForest(num_trees=3, max_depth=4).fit(df, "y").model.getCacheNodeIds()


def test_one_class(spark, monkeypatch):
    """With a single label the votes have fewer than two entries."""
    _, df = rows(spark, 30)
    monkeypatch.setattr(base, "TREE_ROWS", 30)
    got = RandomForest(num_trees=2, max_depth=3).fit(df.selectExpr("vec_id", "features", "0 as y"), "y").predict_proba(df)
    assert {r["prob"] for r in got.collect()} == {0.0}
