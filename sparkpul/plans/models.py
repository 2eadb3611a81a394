"""PU algorithms (M4-M10, X3, X6): two-step iterative, ProbTagging, non-negative PU.

All take a PU table (id, ``features`` array<double>, ``y_pu`` 1/0) and return a
fitted model with ``predict_proba(df)`` / ``predict(df)``. Loops run on the driver,
but every round is a DataFrame plan; role tables are checkpointed to the shared
checkpoint folder each round so the lineage does not grow and a lost executor only
recomputes one round.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import metrics as M
from ..operators.knn import credibility
from ..operators.ranking import tail_cuts
from ..operators.splits import DEFAULT_SEED, bernoulli_tag_array
from ..session import materialize, materialize_bucketed, ship_package
from .base import Fitted
from .parallel import run_parallel

# ----------------------------------------------------------------------------- stop criteria


def metric_value(name: str, df: DataFrame, y: str, pred: str) -> float:
    """accuracy, f1 (PU-F1) or aul (on hard predictions), as the stop criteria use them."""
    if name == "accuracy":
        r = M.classification_metrics(df, y, pred).collect()[0]
        return float(r["accuracy"])
    if name == "f1":
        v = M.pu_f1(df, y, pred).collect()[0]["pu_f1"]
        return float("nan") if v is None else float(v)
    if name == "aul":
        # predictions are hard labels here: the closed form needs one aggregate
        v = M.aul_binary(df, y, pred).collect()[0]["aul"]
        return float("nan") if v is None else float(v)
    raise ValueError(f"unknown metric {name}")


class StopOnMetricDrop:
    """Stop when the validation metric drops (M5); equality continues. The model that
    dropped is the one kept, as in the reference."""

    def __init__(self, metric_name: str):
        self.metric_name = metric_name
        self.last = float("-inf")

    def check(self, model: Fitted, val: DataFrame, y: str = "y_pu") -> tuple[bool, float]:
        pred = model.predict(val, out="_pred")
        score = metric_value(self.metric_name, pred, y, "_pred")
        if score < self.last:
            return True, score
        self.last = score
        return False, score


class NonStop:
    """Never stop; report the metric (M6)."""

    def __init__(self, metric_name: str):
        self.metric_name = metric_name

    def check(self, model: Fitted, val: DataFrame, y: str = "y_pu") -> tuple[bool, float]:
        pred = model.predict(val, out="_pred")
        return False, metric_value(self.metric_name, pred, y, "_pred")


# ----------------------------------------------------------------------------- two-step


class TwoStep:
    """Two-step iterative classifier (M4).

    Detect reliable negatives, then per round: fit the classifier on P (1) vs N (0),
    ask the stop rule on the validation rows, and move the lowest ``floor(frac |U|)``
    unlabeled rows by probability to N and the highest to P. ``rank_by='label'`` ranks
    by hard labels as the reference does (B4); ``floor(frac |U|) = 0`` moves nothing
    and stops (B5); ``move_positive=False`` moves only negatives (B6).
    """

    def __init__(self, detector, stop, classifier, frac_to_move: float = 0.01, max_iterations: int = 100,
                 id_col: str = "vec_id", rank_by: str = "proba", move_positive: bool = True):
        if frac_to_move > 0.5:
            raise ValueError("frac_to_move must be at most 0.5")
        self.detector, self.stop, self.classifier = detector, stop, classifier
        self.frac, self.max_iterations, self.id_col = frac_to_move, max_iterations, id_col
        self.rank_by, self.move_positive = rank_by, move_positive
        self.validation_results: list[float] = []
        self.iterations = 0

    def fit(self, train: DataFrame, val: DataFrame | None = None, features: str = "features", y: str = "y_pu") -> "TwoStep":
        idc = self.id_col
        # written once in buckets by id: every round joins ids and roles with it where it
        # lies, and no vector is shuffled again
        base = materialize_bucketed(train.select(idc, features, y), "two-step-rows", idc)
        roles = materialize(self.detector.detect(base, idc, y, features).select(idc, "role"), "roles")
        model = None
        for it in range(self.max_iterations):
            self.iterations = it + 1
            sizes = {r["role"]: r["n"] for r in roles.groupBy("role").agg(F.count(F.lit(1)).alias("n")).collect()}
            known = roles.where(F.col("role").isin("P", "N")).select(idc, (F.col("role") == "P").cast("int").alias("_label"))
            lab = self._joined(base, known)
            model = self.classifier.fit(lab, "_label", features, n_rows=sizes.get("P", 0) + sizes.get("N", 0))
            if self.stop is not None and val is not None:
                should_stop, value = self.stop.check(model, val, y)
                self.validation_results.append(value)
                if should_stop:
                    break
            n_unl = sizes.get("U", 0)
            if math.floor(n_unl * self.frac) == 0:
                break
            unl = self._joined(base, roles.where(F.col("role") == "U").select(idc), "left_semi")
            if self.rank_by == "label":
                scored = model.predict(unl, features, "_s")
            else:
                scored = model.predict_proba(unl, features, "_s")
            scored = materialize(scored.select(idc, F.round(F.col("_s").cast("double"), 12).alias("_s")), "scores")
            cuts = tail_cuts(scored, "_s", idc, self.frac, n_rows=n_unl)
            moved = cuts.where(F.col("low") | (F.col("high") & F.lit(self.move_positive))).select(
                idc, F.when(F.col("low"), "N").otherwise("P").alias("_new")
            )
            roles = materialize(
                roles.join(moved, idc, "left").select(idc, F.coalesce(F.col("_new"), F.col("role")).alias("role")), "roles"
            )
        roles = base.join(roles, idc)
        self.model = model
        self.roles = roles
        return self

    def _joined(self, base: DataFrame, ids: DataFrame, how: str = "inner") -> DataFrame:
        """Bucketed rows with what is known of their ids: only the ids move."""
        return base.join(ids.hint("merge"), self.id_col, how)

    def predict_proba(self, df, features="features", out="prob"):
        return self.model.predict_proba(df, features, out)

    def predict(self, df, features="features", out="prediction"):
        return self.model.predict(df, features, out)

    def validation_table(self, spark) -> DataFrame:
        """The validation metric of every round as a table (iteration, metric)."""
        rows = [(i + 1, float(v)) for i, v in enumerate(self.validation_results)]
        return spark.createDataFrame(rows, "iteration int, metric double")


# ----------------------------------------------------------------------------- ProbTagging


class ProbTagging(Fitted):
    """ProbTagging (M7): credibility of each unlabeled row = share of known positives
    among its k nearest rows (itself included); ``m`` tagged copies of U, label 1 with
    probability = credibility; one classifier per copy, trained on U rows only.
    ``predict`` = mean hard vote ``> prior``; ``predict_proba`` = mean probability."""

    def __init__(self, knn_num_samples: int, classifier_factory: Callable[[], object], num_classifiers: int,
                 positive_prior: float | None = None, seed: int = DEFAULT_SEED, id_col: str = "vec_id"):
        self.k, self.factory, self.m = knn_num_samples, classifier_factory, num_classifiers
        self.positive_prior, self.seed, self.id_col = positive_prior, seed, id_col

    def fit(self, train: DataFrame, val: DataFrame | None = None, features: str = "features", y: str = "y_pu"):
        idc = self.id_col
        cred = credibility(train.select(idc, features, y), self.k, idc, features, y)
        # every row once, with the tags of all m copies in one array
        tags = cred.select(idc, bernoulli_tag_array(idc, "credibility", self.m, self.seed).alias("tags"))
        data = materialize(train.where(F.col(y) == 0).select(idc, features).join(tags, idc), "tagged")
        member = self.factory()
        if hasattr(member, "fit_many"):
            # one pass over the rows serves all members
            self.models = member.fit_many(data, "tags", self.m, features)
        else:
            # the m fits are independent: submitted side by side
            self.models = run_parallel(
                list(range(self.m)),
                lambda j: self.factory().fit(data.select(idc, features, F.col("tags")[j].alias("tag")), "tag", features),
            )
        if self.positive_prior is None:
            self.positive_prior = float(train.agg(F.avg(F.col(y).cast("double"))).collect()[0][0])
        self.threshold = self.positive_prior
        return self

    def _mean(self, df, features, hard: bool, out: str):
        if all(getattr(m, "linear", None) is not None for m in self.models):
            return df.withColumn(out, self._linear_mean(hard)(F.col(features).cast("array<double>")))
        cur = df
        cols = []
        for j, m in enumerate(self.models):
            cur = (m.predict(cur, features, f"_v{j}") if hard else m.predict_proba(cur, features, f"_v{j}"))
            cols.append(F.col(f"_v{j}").cast("double"))
        mean = sum(cols[1:], cols[0]) / len(cols)
        return cur.withColumn(out, mean).drop(*[f"_v{j}" for j in range(len(self.models))])

    def _linear_mean(self, hard: bool):
        """All linear members at once: one matrix product per Arrow batch."""
        w = np.array([m.linear[0] for m in self.models])
        b = np.array([m.linear[1] for m in self.models])

        @F.pandas_udf("double")
        def mean(x: pd.Series) -> pd.Series:
            if len(x) == 0:
                return pd.Series([], dtype="float64")
            margin = np.stack(x.to_numpy()) @ w.T + b
            votes = (margin > 0).astype(float) if hard else 1.0 / (1.0 + np.exp(-margin))
            return pd.Series(votes.mean(axis=1))

        return mean

    def predict_proba(self, df, features="features", out="prob"):
        return self._mean(df, features, False, out)

    def predict(self, df, features="features", out="prediction"):
        v = self._mean(df, features, True, "_vote")
        return v.withColumn(out, (F.col("_vote") > F.lit(self.positive_prior)).cast("int")).drop("_vote")


# ----------------------------------------------------------------------------- nnPU


def _forward(x: np.ndarray, weights: list[tuple[np.ndarray, np.ndarray]]):
    acts = [x]
    h = x
    for i, (w, b) in enumerate(weights):
        z = h @ w + b
        h = 1.0 / (1.0 + np.exp(-z)) if i == len(weights) - 1 else np.maximum(z, 0.0)
        acts.append(h)
    return acts


def _backward(acts, weights, dz_out: np.ndarray):
    """Gradients of sum(dz_out * z_out) w.r.t. all weights (ReLU hidden layers)."""
    grads = [None] * len(weights)
    delta = dz_out
    for i in range(len(weights) - 1, -1, -1):
        w, _ = weights[i]
        grads[i] = (acts[i].T @ delta, delta.sum(axis=0))
        if i > 0:
            delta = (delta @ w.T) * (acts[i] > 0)
    return grads


# Partition gradient rows collected directly; more are summed on executors first.
DIRECT_GRADIENT_ROWS = 64


def _sum_rows(batches):
    acc = None
    for pdf in batches:
        for g in pdf["g"]:
            v = np.asarray(g)
            acc = v if acc is None else acc + v
    if acc is not None:
        yield pd.DataFrame({"g": [acc.tolist()]})


class NonNegativePU(Fitted):
    """Non-negative PU classifier.

    Model: dense layers ``layer_sizes`` (ReLU, sigmoid output); ``[1]`` is the linear
    model the experiments use. With ``batch_rows`` the epochs are mini-batch passes inside
    tasks, several epochs a job (see ``plans.stacked``, which also trains many cells at
    once). Without, each epoch is one full-batch step: ``mapInPandas``
    sums the gradients of the three risk terms per partition, the driver adds the
    partition rows and takes an Adam step on the small weight vector. With
    ``positive_prior='auto'`` the prior starts at 0.5 and becomes the predicted
    positive rate on the validation rows after each epoch (A14), without resetting the
    optimizer (B11). Clipped losses give zero gradient past the clip (B10).
    """

    def __init__(self, layer_sizes: Sequence[int] = (1,), positive_prior=0.5, epochs: int = 200,
                 learning_rate: float = 0.001, seed: int = DEFAULT_SEED, eps: float = 1e-7,
                 reduce_lr_on_plateau: bool = False, patience: int = 10, factor: float = 0.1,
                 min_delta: float = 1e-4, batch_rows: int | None = None, id_col: str = "vec_id"):
        self.batch_rows, self.id_col = batch_rows, id_col
        self.layer_sizes, self.positive_prior = list(layer_sizes), positive_prior
        self.epochs, self.lr, self.seed, self.eps = epochs, learning_rate, seed, eps
        self.plateau = (reduce_lr_on_plateau, patience, factor, min_delta)
        self.history: list[dict] = []

    def _init(self, dim: int):
        from .stacked import initial_weights

        return initial_weights(self.layer_sizes, dim, self.seed)

    def fit(self, train: DataFrame, val: DataFrame | None = None, features: str = "features", y: str = "y_pu"):
        if self.batch_rows:
            return self._fit_batches(train, val, features, y)
        ship_package(train.sparkSession)
        # read once per epoch: written out (lineage) and kept in memory while training
        data = materialize(
            train.select(F.col(features).cast("array<double>").alias("_x"), F.col(y).cast("int").alias("_y")), "nnpu-rows"
        )
        data = data.persist()
        try:
            return self._fit_full(data, val, features, y)
        finally:
            data.unpersist()

    def _fit_batches(self, train: DataFrame, val: DataFrame | None, features: str, y: str):
        from .stacked import Cell, Settings, StackedNonNegativePU

        use_plateau, patience, factor, min_delta = self.plateau
        how = Settings(self.batch_rows, self.eps, use_plateau, patience, factor, min_delta)
        cell = Cell(self.positive_prior, self.seed, self.lr)
        one = StackedNonNegativePU([cell], self.layer_sizes, self.epochs, settings=how, id_col=self.id_col)
        fitted = one.fit(train, val, features, y).models[0]
        self.weights, self.prior, self.history = fitted.weights, fitted.prior, fitted.history
        return self

    def _fit_full(self, data: DataFrame, val: DataFrame | None, features: str, y: str):
        dim = len(data.select("_x").first()["_x"])
        n_parts = data.rdd.getNumPartitions()
        self.weights = self._init(dim)
        prior = 0.5 if self.positive_prior == "auto" else float(self.positive_prior)
        m = [(np.zeros_like(w), np.zeros_like(b)) for w, b in self.weights]
        v = [(np.zeros_like(w), np.zeros_like(b)) for w, b in self.weights]
        b1, b2, ae = 0.9, 0.999, 1e-7
        lr = self.lr
        use_plateau, patience, factor, min_delta = self.plateau
        best, wait = float("inf"), 0
        n_params = sum(w.size + b.size for w, b in self.weights)
        eps = self.eps
        for epoch in range(1, self.epochs + 1):
            weights = self.weights

            def partial(batches):
                acc = None
                for pdf in batches:
                    if len(pdf) == 0:
                        continue
                    x = np.stack(pdf["_x"].to_numpy())
                    yv = pdf["_y"].to_numpy()
                    acts = _forward(x, weights)
                    p = acts[-1][:, 0]
                    pc = np.clip(p, eps, 1 - eps)
                    inside = ((p > eps) & (p < 1 - eps)).astype(float)
                    pos, unl = yv == 1, yv == 0
                    # d loss / d z_out for the three terms (sigmoid output)
                    d_pp = np.where(pos, -(1 - p) * inside, 0.0)
                    d_pn = np.where(pos, p * inside, 0.0)
                    d_u = np.where(unl, p * inside, 0.0)
                    vec = []
                    for d in (d_pp, d_pn, d_u):
                        for gw, gb in _backward(acts, weights, d[:, None]):
                            vec.append(gw.ravel())
                            vec.append(gb.ravel())
                    scal = np.array([
                        pos.sum(), unl.sum(),
                        (-np.log(pc) * pos).sum(), (-np.log(1 - pc) * pos).sum(), (-np.log(1 - pc) * unl).sum(),
                    ], dtype=float)
                    cur = np.concatenate([scal] + vec)
                    acc = cur if acc is None else acc + cur
                if acc is not None:
                    yield pd.DataFrame({"g": [acc.tolist()]})

            parts = data.mapInPandas(partial, "g array<double>")
            if n_parts > DIRECT_GRADIENT_ROWS:
                # second level: ~sqrt(P) groups sum the partition rows before the driver
                parts = parts.repartition(int(math.ceil(math.sqrt(n_parts)))).mapInPandas(_sum_rows, "g array<double>")
            rows = parts.collect()
            tot = np.sum([np.asarray(r["g"]) for r in rows], axis=0)
            n_p, n_u, l_pp, l_pn, l_u = tot[:5]
            n_p, n_u = max(n_p, 1.0), max(n_u, 1.0)
            g = tot[5:].reshape(3, n_params)
            neg = l_u / n_u - prior * l_pn / n_p
            risk = prior * l_pp / n_p + max(0.0, neg)
            grad = prior * g[0] / n_p + ((g[2] / n_u - prior * g[1] / n_p) if neg > 0 else 0.0)
            # Adam step on the flat parameter vector
            off = 0
            new_w = []
            for i, (w, b) in enumerate(self.weights):
                gw = grad[off: off + w.size].reshape(w.shape)
                off += w.size
                gb = grad[off: off + b.size]
                off += b.size
                mw, mb = m[i]
                vw, vb = v[i]
                mw, mb = b1 * mw + (1 - b1) * gw, b1 * mb + (1 - b1) * gb
                vw, vb = b2 * vw + (1 - b2) * gw * gw, b2 * vb + (1 - b2) * gb * gb
                m[i], v[i] = (mw, mb), (vw, vb)
                lr_t = lr * math.sqrt(1 - b2**epoch) / (1 - b1**epoch)
                new_w.append((w - lr_t * mw / (np.sqrt(vw) + ae), b - lr_t * mb / (np.sqrt(vb) + ae)))
            self.weights = new_w
            if self.positive_prior == "auto" and val is not None:
                prior = float(self.predict(val, features, "_pr").agg(F.avg("_pr")).collect()[0][0])
            monitored = float(risk)
            if use_plateau:
                # Keras ReduceLROnPlateau: validation loss when there is validation data
                if val is not None:
                    vr = M.nnpu_risk(self.predict_proba(val, features, "_vp"), y, "_vp", prior).collect()[0]
                    monitored = float(vr["nnpu_risk"]) if vr["nnpu_risk"] is not None else monitored
                if monitored < best - min_delta:
                    best, wait = monitored, 0
                else:
                    wait += 1
                    if wait >= patience:
                        lr, wait = lr * factor, 0
            self.history.append({"epoch": epoch, "risk": float(risk), "monitored": monitored, "prior": prior, "lr": lr})
        self.prior = prior
        return self

    def predict_proba(self, df, features="features", out="prob"):
        if self.layer_sizes == [1]:
            from .base import dot_plus

            w, b = self.weights[0]
            z = dot_plus(features, w[:, 0], float(b[0]))
            return df.withColumn(out, F.lit(1.0) / (F.lit(1.0) + F.exp(-z)))
        weights = self.weights
        ship_package(df.sparkSession)

        @F.pandas_udf("double")
        def _mlp(col: pd.Series) -> pd.Series:
            x = np.stack(col.to_numpy())
            return pd.Series(_forward(x, weights)[-1][:, 0])

        return df.withColumn(out, _mlp(F.col(features).cast("array<double>")))
