"""The stacked nnPU trainer: cells alone and together, a plain one-machine run, job counts."""

import numpy as np
import pytest

from sparkpul.plans import stacked
from sparkpul.plans.models import NonNegativePU
from sparkpul.plans.stacked import Cell, Settings, StackedNonNegativePU


def frames(spark, n=260, d=4, seed=2):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, d))
    y = (x @ np.array([1.5, -1.0, 0.5, 0.0])[:d] + 0.5 * rng.normal(size=n) > 0.4).astype(int) * (rng.random(n) < 0.6)
    rows = [(i, x[i].tolist(), int(y[i])) for i in range(n)]
    df = spark.createDataFrame(rows, "vec_id long, features array<double>, y_pu int")
    return df.where("vec_id < 200").repartition(3), df.where("vec_id >= 200")


CELLS = [Cell(0.3, 1, 0.01), Cell(0.5, 2, 0.01), Cell("auto", 3, 0.02), Cell(0.7, 1, 0.001)]


@pytest.mark.parametrize("layers", [[1], [5, 1]])
@pytest.mark.parametrize("shard_rows", [2048, 40])
def test_stack_equals_single_cells(spark, monkeypatch, layers, shard_rows):
    monkeypatch.setattr(stacked, "SHARD_ROWS", shard_rows)
    train, val = frames(spark)
    how = Settings(16, plateau=True, patience=2, min_delta=1e-3)
    together = StackedNonNegativePU(CELLS, layers, 12, 4, how).fit(train, val)
    assert together.jobs == 3
    for j, cell in enumerate(CELLS):
        alone = StackedNonNegativePU([cell], layers, 12, 4, how).fit(train, val)
        for (w, b), (w1, b1) in zip(together.models[j].weights, alone.models[0].weights):
            assert np.allclose(w, w1, atol=1e-9) and np.allclose(b, b1, atol=1e-9)
        assert together.models[j].prior == pytest.approx(alone.models[0].prior, abs=1e-12)
        assert np.allclose(together.history[:, :, j], alone.history[:, :, 0], atol=1e-9)


def plain_run(blocks, cell, epochs, how, dim):
    """One machine, one cell, linear model: mini-batch Adam written out."""
    (shard, x, labels), = blocks
    held, pos = labels[:, 1] == 1, labels[:, 0] == 1
    xt, pt, xv, pv = x[~held], pos[~held], x[held], pos[held]
    (w, b), = stacked.initial_weights([1], dim, cell.seed)
    theta = np.append(w[:, 0], b)
    m, v, t = np.zeros(dim + 1), np.zeros(dim + 1), 0
    prior, rate, best, wait = (0.5 if cell.prior == "auto" else cell.prior), cell.learning_rate, 1e300, 0
    for e in range(epochs):
        order = np.random.default_rng([how.shuffle_seed, shard, e]).permutation(len(xt))
        for at in range(0, len(order), how.batch_rows):
            pick = order[at : at + how.batch_rows]
            a, p = np.hstack([xt[pick], np.ones((len(pick), 1))]), pt[pick]
            s = 1 / (1 + np.exp(-a @ theta))
            n_p, n_u = max(p.sum(), 1), max((~p).sum(), 1)
            neg = -np.log(1 - s[~p]).sum() / n_u + prior * np.log(1 - s[p]).sum() / n_p
            g = prior * a[p].T @ (s[p] - 1) / n_p
            if neg > 0:
                g = g + a[~p].T @ s[~p] / n_u - prior * a[p].T @ s[p] / n_p
            t += 1
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            theta = theta - rate * np.sqrt(1 - 0.999**t) / (1 - 0.9**t) * m / (np.sqrt(v) + 1e-7)
        s = 1 / (1 + np.exp(-(xv @ theta[:-1] + theta[-1])))
        neg = -np.log(1 - s[~pv]).sum() / max((~pv).sum(), 1) + prior * np.log(1 - s[pv]).sum() / max(pv.sum(), 1)
        loss = -prior * np.log(s[pv]).sum() / max(pv.sum(), 1) + max(0, neg)
        if cell.prior == "auto":
            prior = (s > 0.5).mean()
        if how.plateau:
            if loss < best - how.min_delta:
                best, wait = loss, 0
            else:
                wait += 1
                if wait >= how.patience:
                    rate, wait = rate * how.factor, 0
    return theta, prior, rate


def test_one_block_is_a_plain_run(spark):
    """A table of one block: the published training loop, whatever epochs a job takes."""
    train, val = frames(spark)
    how = Settings(32, plateau=True, patience=1, min_delta=0.01)
    fit = StackedNonNegativePU(CELLS, [1], 9, 4, how).fit(train, val)
    packed = fit._blocks(train, val, "features", "y_pu").collect()
    blocks = [(r["shard"], np.frombuffer(r["x"]).reshape(r["n"], -1), np.frombuffer(r["y"]).reshape(r["n"], -1)) for r in packed]
    assert len(blocks) == 1 and sum(len(b[1]) for b in blocks) == 260
    for j, cell in enumerate(CELLS):
        theta, prior, rate = plain_run(blocks, cell, 9, how, 4)
        (w, b), = fit.models[j].weights
        assert np.allclose([*w[:, 0], b[0]], theta, atol=1e-9)
        assert fit.models[j].prior == pytest.approx(prior, abs=1e-12) and fit.history[-1, 3, j] == pytest.approx(rate)


def test_job_count(spark):
    """200 epochs of four models: 20 passes, and few jobs beside them."""
    train, val = frames(spark)
    train, val = train.cache(), val.cache()
    sc, group = spark.sparkContext, "nnpu-jobs"
    sc.setJobGroup(group, "count jobs")
    fit = StackedNonNegativePU(CELLS, [1], 200).fit(train, val)
    jobs = len(sc.statusTracker().getJobIdsForGroup(group))
    sc.setLocalProperty("spark.jobGroup.id", None)
    assert fit.jobs == 20 and len(fit.history) == 200 and jobs < 35


def test_learns_and_averages(spark, monkeypatch):
    """Many shards reach about the risk of one."""
    train, val = frames(spark, n=260)
    one = StackedNonNegativePU([Cell(0.5, 1, 0.01)], [1], 40).fit(train, val)
    monkeypatch.setattr(stacked, "SHARD_ROWS", 50)
    many = StackedNonNegativePU([Cell(0.5, 1, 0.01)], [1], 40, 2).fit(train, val)
    assert one.history[-1, 0, 0] < one.history[0, 0, 0]
    assert many.history[-1, 0, 0] < many.history[0, 0, 0]


def test_class_interface(spark):
    train, val = frames(spark)
    model = NonNegativePU([1], "auto", epochs=5, learning_rate=0.01, batch_rows=32).fit(train, val)
    assert len(model.history) == 5 and model.prior == model.history[-1]["prior"]
    out = model.predict(model.predict_proba(val, out="p"), out="y").toPandas()
    assert out["p"].between(0, 1).all() and ((out["p"] > 0.5) == (out["y"] == 1)).all()


def test_odd_rows(spark):
    """Repeated ids, missing features and a table without validation rows."""
    train, _ = frames(spark)
    odd = train.unionByName(train.where("vec_id < 3")).unionByName(spark.createDataFrame([(None, None, 1), (None, [0.0] * 4, 0)], train.schema))
    model = NonNegativePU([1], 0.5, epochs=2, batch_rows=8).fit(odd)
    assert np.isfinite(model.weights[0][0]).all()
    with pytest.raises(ValueError):
        NonNegativePU([1], 0.5, epochs=2, batch_rows=8).fit(train.limit(0))
