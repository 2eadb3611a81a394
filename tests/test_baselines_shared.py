"""PN baselines: the kNN classifiers of a setting share one join, the others are fitted on their own."""

import time
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pytest

from sparkpul.plans import base
from sparkpul.plans import grid as G
from sparkpul.plans.base import KNeighbours
from sparkpul.session import ship_package


def splits(spark, n=160):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(n, 3))
    y = (x[:, 0] + 0.5 * rng.normal(size=n) > 0).astype(int)
    df = spark.createDataFrame(
        [(i, x[i].tolist(), int(y[i]), int(y[i])) for i in range(n)], "vec_id long, features array<double>, y_pu int, y_true int"
    )
    return df.where("vec_id % 4 > 1"), df.where("vec_id % 4 = 1"), df.where("vec_id % 4 = 0")


@pytest.fixture
def joins(monkeypatch):
    asked, plain = [], base.knn_join

    def counted(q, ref, k, *rest, **kw):
        asked.append(k)
        return plain(q, ref, k, *rest, **kw)

    monkeypatch.setattr(base, "knn_join", counted)
    return asked


def test_one_join_a_setting(spark, joins):
    train, val, test = splits(spark)
    settings = [G.Setting(name, lambda: (train, val, test)) for name in ("a", "b")]
    got = G.pn_baselines(spark, settings, ["kneighbours-3", "naivebayes", "kneighbours-19", "kneighbours-7"])
    rows = {(r["setting"], r["classifier"]): r for r in got.collect()}
    assert sorted(joins) == [19, 19] and len(rows) == 8
    both = train.unionByName(val)
    for k in (3, 7, 19):
        alone = KNeighbours(k).fit(both, "y_true").predict(test, out="y_pred")
        scores = G.evaluate_predictions(alone)
        for name in ("a", "b"):
            for metric in ("balanced_accuracy", "accuracy", "f1"):
                assert rows[name, f"kneighbours-{k}"][metric] == pytest.approx(scores[metric], abs=1e-12)


def test_other_rows_are_asked_anew(spark, joins):
    train, val, test = splits(spark)
    three, five = KNeighbours().fit_many(train, "y_true", [3, 5])
    for df in (test, val):
        for model, k in ((three, 3), (five, 5)):
            got = {r["vec_id"]: r["prob"] for r in model.predict_proba(df).collect()}
            alone = {r["vec_id"]: r["prob"] for r in KNeighbours(k).fit(train, "y_true").predict_proba(df).collect()}
            assert got == alone and len(got) == df.count()
    assert joins == [5, 3, 5, 5, 3, 5]


def test_finished_cells_are_not_run_again(spark, joins, tmp_path):
    train, val, test = splits(spark)
    settings = [G.Setting("a", lambda: (train, val, test))]
    path = str(tmp_path / "grid")
    G.pn_baselines(spark, settings, ["kneighbours-7"], path).collect()
    got = G.pn_baselines(spark, settings, ["kneighbours-7", "kneighbours-3"], path).collect()
    assert joins == [7, 3] and sorted(r["classifier"] for r in got) == ["kneighbours-3", "kneighbours-7"]


def test_package_is_shipped_once_by_threads():
    shipped = []

    class Context:
        _jsc = object()

        def addPyFile(self, path):
            time.sleep(0.05)
            shipped.append(path)

    class Session:
        sparkContext = Context()

    with ThreadPoolExecutor(4) as pool:
        list(pool.map(lambda _: ship_package(Session), range(4)))
    assert len(shipped) == 1
