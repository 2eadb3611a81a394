"""Model fits against independent numpy implementations on small fixtures."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from sparkpul.plans.base import make_classifier
from sparkpul.plans.grid import pca_projection
from sparkpul.plans.models import NonNegativePU


def _fixture(spark, n=80, d=3, seed=5):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, d))
    y = (x @ np.array([1.5, -1.0, 0.5])[:d] + 0.3 * rng.normal(size=n) > 0).astype(int)
    rows = [(i, x[i].tolist(), int(y[i])) for i in range(n)]
    return x, y, spark.createDataFrame(rows, "vec_id long, features array<double>, y int")


def test_logistic_matches_sklearn_objective(spark):
    """MLlib with regParam = 1/(C n) minimises C * sum(logloss) + |w|^2 / 2 (intercept free)."""
    x, y, df = _fixture(spark)
    model = make_classifier("logistic", C=1.0, max_iter=200).fit(df, "y")
    got = model.predict_proba(df, out="p").toPandas().sort_values("vec_id")["p"].to_numpy()
    # Newton's method on the same objective
    xa = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(xa.shape[1])
    reg = np.diag([1.0] * x.shape[1] + [0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-xa @ w))
        grad = xa.T @ (p - y) + reg @ w
        hess = xa.T @ (xa * (p * (1 - p))[:, None]) + reg
        w -= np.linalg.solve(hess, grad)
    exp = 1 / (1 + np.exp(-xa @ w))
    assert np.allclose(got, exp, atol=2e-3)


def test_nnpu_first_step_matches_numpy(spark):
    x, y, df = _fixture(spark)
    df = df.withColumnRenamed("y", "y_pu")
    prior, lr = 0.4, 0.1
    algo = NonNegativePU([1], prior, epochs=1, learning_rate=lr, seed=3)
    w0, b0 = algo._init(x.shape[1])[0]
    algo.fit(df)
    z = x @ w0[:, 0] + b0[0]
    p = 1 / (1 + np.exp(-z))
    pos, unl = y == 1, y == 0
    g_pp = ((p - 1)[pos, None] * x[pos]).sum(0) / pos.sum(), (p - 1)[pos].sum() / pos.sum()
    g_pn = (p[pos, None] * x[pos]).sum(0) / pos.sum(), p[pos].sum() / pos.sum()
    g_u = (p[unl, None] * x[unl]).sum(0) / unl.sum(), p[unl].sum() / unl.sum()
    neg = np.mean(-np.log(1 - p[unl])) - prior * np.mean(-np.log(1 - p[pos]))
    gw = prior * g_pp[0] + ((g_u[0] - prior * g_pn[0]) if neg > 0 else 0.0)
    gb = prior * g_pp[1] + ((g_u[1] - prior * g_pn[1]) if neg > 0 else 0.0)
    # first Adam step: lr * sqrt(1 - b2) / (1 - b1) * m / (sqrt(v) + eps)
    def step(g):
        m, v = 0.1 * g, 0.001 * g * g
        return lr * math.sqrt(1 - 0.999) / (1 - 0.9) * m / (np.sqrt(v) + 1e-7)
    w1, b1 = algo.weights[0]
    assert np.allclose(w1[:, 0], w0[:, 0] - step(gw), atol=1e-9)
    assert np.allclose(b1, b0 - step(np.array([gb])), atol=1e-9)


def test_pca_matches_svd(spark):
    x, _, df = _fixture(spark, n=50, d=3)
    got = pca_projection(df, "vec_id").toPandas().sort_values("vec_id")[["pc1", "pc2"]].to_numpy()
    xc = x - x.mean(0)
    _, _, vt = np.linalg.svd(xc, full_matrices=False)
    comps = vt[:2].copy()
    for j in range(2):
        if comps[j][np.argmax(np.abs(comps[j]))] < 0:
            comps[j] = -comps[j]
    assert np.allclose(got, xc @ comps.T, atol=1e-8)


def test_calibrated_svm_probabilities(spark):
    x, y, df = _fixture(spark, n=100)
    model = make_classifier("svm", folds=3).fit(df, "y")
    out = model.predict(model.predict_proba(df, out="p"), out="pred").toPandas()
    assert out["p"].between(0, 1).all()
    assert (out["pred"] == pd.Series(y)[out["vec_id"].to_numpy()].to_numpy()).mean() > 0.85


def test_nnpu_plateau_reduces_learning_rate(spark):
    _, _, df = _fixture(spark)
    df = df.withColumnRenamed("y", "y_pu")
    algo = NonNegativePU([1], 0.4, epochs=8, learning_rate=0.5, reduce_lr_on_plateau=True, patience=1,
                         min_delta=10.0).fit(df)
    lrs = [h["lr"] for h in algo.history]
    # min_delta is so large that no epoch improves after the first: the rate drops every epoch
    assert lrs[0] == 0.5 and lrs[-1] < lrs[1] < 0.5


def test_mlp_backprop_matches_finite_differences():
    """Gradients of the three nnPU risk terms through a ReLU MLP."""
    from sparkpul.plans.models import _backward, _forward

    rng = np.random.default_rng(11)
    x = rng.normal(size=(12, 3))
    pos = rng.random(12) < 0.5
    weights = [(rng.normal(size=(3, 5)), rng.normal(size=5)), (rng.normal(size=(5, 4)), rng.normal(size=4)),
               (rng.normal(size=(4, 1)), rng.normal(size=1))]

    def terms(ws):
        p = _forward(x, ws)[-1][:, 0]
        return np.array([(-np.log(p) * pos).sum(), (-np.log(1 - p) * pos).sum(), (-np.log(1 - p) * ~pos).sum()])

    acts = _forward(x, weights)
    p = acts[-1][:, 0]
    d_out = [np.where(pos, -(1 - p), 0.0), np.where(pos, p, 0.0), np.where(~pos, p, 0.0)]
    for t, d in enumerate(d_out):
        grads = _backward(acts, weights, d[:, None])
        for layer, (gw, gb) in enumerate(grads):
            for arr_idx, g in ((0, gw), (1, gb)):
                flat = weights[layer][arr_idx].ravel()
                for j in range(flat.size):
                    h = 1e-6
                    plus = [(w.copy(), b.copy()) for w, b in weights]
                    minus = [(w.copy(), b.copy()) for w, b in weights]
                    plus[layer][arr_idx].ravel()[j] += h
                    minus[layer][arr_idx].ravel()[j] -= h
                    num = (terms(plus)[t] - terms(minus)[t]) / (2 * h)
                    assert g.ravel()[j] == pytest.approx(num, rel=1e-4, abs=1e-6)
