"""The grid runner on the caller's own frames: result rows, predictions, resume."""

from __future__ import annotations

import numpy as np
import pytest

from sparkpul.operators.detectors import RandomDetector
from sparkpul.plans import grid as G
from sparkpul.plans.base import make_classifier
from sparkpul.session import scratch_path


def _frames(spark, seed, shift=2.0):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(120):
        y = i % 2
        x = rng.normal(size=3) + (shift if y else -shift)
        rows.append((i, x.tolist(), int(y and i % 4 == 1), y))
    df = spark.createDataFrame(rows, "vec_id long, features array<double>, y_pu int, y_true int")
    return df.where("vec_id < 60"), df.where("vec_id >= 60 and vec_id < 80"), df.where("vec_id >= 80")


class Spy:
    fits: list = []

    def __init__(self, cell):
        self.cell = cell
        self.inner = G.Supervised(make_classifier(cell["classifier"]))

    def fit(self, train, val):
        Spy.fits.append((self.cell["setting"], self.cell["classifier"]))
        if self.cell["setting"] == "b" and self.cell["classifier"] == "naivebayes" and len(Spy.fits) < 5:
            raise RuntimeError("a lost cell")
        return self.inner.fit(train, val)


def test_grid_resumes_only_missing_cells(spark):
    path = scratch_path(spark, "t-grid")
    train_a = _frames(spark, 1)
    train_b = (*_frames(spark, 2)[:2], _frames(spark, 1)[2])  # test rows of another source
    settings = [G.Setting("a", lambda: train_a, "x", 1.0), G.Setting("b", lambda: train_b, "x", 2.0)]
    cells = G.cross(setting=["a", "b"], classifier=["logistic", "naivebayes"])
    Spy.fits = []
    with pytest.raises(RuntimeError, match="a lost cell"):
        G.run_grid(spark, settings, cells, Spy, path, parallel=1)
    assert len(Spy.fits) == 4
    Spy.fits.append(("pad", ""))
    out = G.run_grid(spark, settings, cells, Spy, path, parallel=1).collect()
    assert Spy.fits[5:] == [("b", "naivebayes")]
    assert {(r["setting"], r["classifier"]) for r in out} == {(c["setting"], c["classifier"]) for c in cells}
    assert all(r["balanced_accuracy"] > 0.9 for r in out)
    pred = G.predictions(spark, path)
    assert pred.count() == 4 * 40 and set(pred.columns) >= {"vec_id", "y_true", "y_pu", "y_pred", "setting", "classifier"}
    Spy.fits = []
    assert G.run_grid(spark, settings, cells[:1], Spy, path).count() == 1 and Spy.fits == []


def test_runners_on_own_frames(spark):
    frames = _frames(spark, 3)
    settings = [G.Setting("s", lambda: frames, "x", 1.0)]
    grid = G.experiment_grid(spark, settings, ["naivebayes"], {"random": lambda: RandomDetector(0.3)}, 0.1, 2).collect()
    assert len(grid) == 1 and grid[0]["detector"] == "random" and grid[0]["extractor"] == "x"
    base = G.pn_baselines(spark, settings, ["naivebayes", "kneighbours-5"]).collect()
    assert {r["classifier"] for r in base} == {"naivebayes", "kneighbours-5"} and all(r["accuracy"] > 0.9 for r in base)


def test_lock_step_and_cross():
    assert G.lock_step(a=[1, 2, 3], b=["x", "y"]) == [{"a": 1, "b": "x"}, {"a": 2, "b": "y"}]
    assert len(G.cross(a=[1, 2], b=[3, 4, 5])) == 6
