"""What the MLlib fits return, recomputed: k-means centroids, forest votes, components."""

import numpy as np

from sparkpul.operators.detectors import KMeansDetector, nearest_centroid
from sparkpul.plans.base import RandomForest
from sparkpul.plans.grid import pca_projection


def rows(spark, n=300, d=4, seed=9):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, d)) + 4 * rng.integers(0, 3, size=(n, 1))
    y = (x[:, 0] + 0.5 * rng.normal(size=n) > 4).astype(int)
    return x, y, spark.createDataFrame([(i, x[i].tolist(), int(y[i])) for i in range(n)], "vec_id long, features array<double>, y int")


def test_kmeans_is_a_fixed_point(spark):
    """Every row is at its nearest centroid, every centroid is the mean of its rows."""
    x, _, df = rows(spark)
    centroids = KMeansDetector(0.2, 3, max_iter=300).fit_centroids(df, "features")
    nearest = ((x[:, None, :] - centroids[None]) ** 2).sum(-1).argmin(axis=1)
    found = nearest_centroid(df, "features", centroids).orderBy("vec_id").toPandas()["cluster"].to_numpy()
    assert (found == nearest).all() and set(nearest) == {0, 1, 2}
    for c in range(3):
        assert np.allclose(centroids[c], x[nearest == c].mean(axis=0), atol=1e-2)
    # no better start by hand: the means of the three groups the rows were drawn from
    inertia = ((x - centroids[nearest]) ** 2).sum()
    assert inertia < 1.2 * ((x - x.mean(axis=0)) ** 2).sum() / 4


def walk(node, v):
    while node.getClass().getSimpleName() == "InternalNode":
        split = node.split()
        goes_left = v[split.featureIndex()] <= split.threshold()
        node = node.leftChild() if goes_left else node.rightChild()
    return np.array(list(node.impurityStats().stats()))


def test_forest_votes_recomputed_from_its_trees(spark):
    x, y, df = rows(spark)
    model = RandomForest(num_trees=7, max_depth=4).fit(df, "y")
    got = model.predict(model.predict_proba(df, out="p"), out="c").orderBy("vec_id").toPandas()
    trees = [t._java_obj.rootNode() if hasattr(t, "_java_obj") else t._call_java("rootNode") for t in model.model.trees]
    for i in range(0, len(x), 7):
        votes = np.zeros(2)
        for root in trees:
            stats = walk(root, x[i])
            votes += stats / stats.sum()
        assert np.isclose(got["p"][i], votes[1] / votes.sum(), atol=1e-12)
        assert got["c"][i] == int(votes[1] / votes.sum() > 0.5)
    assert (got["c"] == y).mean() > 0.85


def test_components_are_eigenvectors(spark):
    x, _, df = rows(spark)
    got = pca_projection(df, "vec_id").orderBy("vec_id").toPandas()[["pc1", "pc2"]].to_numpy()
    values, vectors = np.linalg.eigh(np.cov(x.T))
    for j, at in enumerate(np.argsort(values)[::-1][:2]):
        v = vectors[:, at] * np.sign(vectors[np.abs(vectors[:, at]).argmax(), at])
        assert np.allclose(got[:, j], (x - x.mean(axis=0)) @ v, atol=1e-8)
        assert np.isclose(got[:, j].var(ddof=1), values[at])
