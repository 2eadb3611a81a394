"""Non-negative PU learning of many cells in one program.

Cells (prior, seed, learning rate) share the rows, so their weights are stacked: the first
layer of all cells is one matrix product per mini-batch. Rows are packed once into blocks
of one shard each. A job is a pass over the blocks: each block starts from the shared
state and takes Adam steps on its own mini-batches for several epochs, then the states
(weights, moments, step count, prior, learning rate) are averaged by rows. So 200 epochs
are 20 jobs at 10 epochs a job, and the driver receives one state vector per task. A table
of one block is trained exactly as one machine would train it.

Within a block an epoch is what the published experiments do: shuffled mini-batches, the
mean of the batch risks as loss, the validation risk on the block's share of the validation
rows; ``prior='auto'`` takes the positive rate on those after every epoch, and the learning
rate falls by ``factor`` when the monitored loss has not fallen for ``patience`` epochs.
Shards and shuffles depend on the rows and ``shuffle_seed`` alone, not on the cell or the
cluster: a cell trained in a stack equals the cell trained alone.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.splits import DEFAULT_SEED
from .blocks import add_up, pack, unpack

#: rows of a shard, about
SHARD_ROWS = 2048
BETA1, BETA2, ADAM_EPS = 0.9, 0.999, 1e-7


@dataclass(frozen=True)
class Cell:
    """One model: class prior (a number or ``'auto'``), initial seed and learning rate."""

    prior: float | str = 0.5
    seed: int = DEFAULT_SEED
    learning_rate: float = 0.001


def initial_weights(layer_sizes: Sequence[int], dim: int, seed: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Glorot-uniform weights and zero biases of a dense network."""
    rng = np.random.default_rng(seed)
    out, fan_in = [], dim
    for size in layer_sizes:
        limit = math.sqrt(6.0 / (fan_in + size))
        out.append((rng.uniform(-limit, limit, size=(fan_in, size)), np.zeros(size)))
        fan_in = size
    return out


class State:
    """All that training changes, per cell: weights, moments, scalars. Kept flat, so that
    states are averaged as vectors."""

    SCALARS = ("steps", "prior", "rate", "best", "wait")

    def __init__(self, cells: int, layer_sizes: Sequence[int], dim: int, flat: np.ndarray | None = None):
        self.cells, self.layer_sizes, self.dim = cells, list(layer_sizes), dim
        fans = [dim, *layer_sizes]
        self.shapes = [s for a, b in zip(fans, fans[1:]) for s in ((cells, a, b), (cells, 1, b))]
        self.params = sum(math.prod(s) for s in self.shapes)
        n = 3 * self.params + len(self.SCALARS) * cells
        self.flat = np.zeros(n) if flat is None else flat
        self.weights, self.first, self.second = (
            self._layers(self.flat[i * self.params : (i + 1) * self.params]) for i in range(3)
        )
        rest = self.flat[3 * self.params :].reshape(len(self.SCALARS), cells)
        self.steps, self.prior, self.rate, self.best, self.wait = rest

    def _layers(self, part: np.ndarray) -> list[np.ndarray]:
        out, at = [], 0
        for shape in self.shapes:
            out.append(part[at : at + math.prod(shape)].reshape(shape))
            at += math.prod(shape)
        return out

    def copy(self) -> State:
        return State(self.cells, self.layer_sizes, self.dim, self.flat.copy())

    def forward(self, x: np.ndarray) -> list[np.ndarray]:
        """Activations of every layer (cells, rows, width); the last are probabilities."""
        w, b = self.weights[0], self.weights[1]
        width = w.shape[2]
        z = (x @ w.transpose(1, 0, 2).reshape(x.shape[1], -1)).reshape(len(x), self.cells, width).transpose(1, 0, 2) + b
        acts = [np.broadcast_to(x, (self.cells, *x.shape))]
        for i in range(2, len(self.weights), 2):
            acts.append(np.maximum(z, 0.0))
            z = acts[-1] @ self.weights[i] + self.weights[i + 1]
        acts.append(1 / (1 + np.exp(-np.clip(z, -700, 700))))
        return acts

    def adam(self, grads: list[np.ndarray]) -> None:
        self.steps += 1
        rate = self.rate * np.sqrt(1 - BETA2**self.steps) / (1 - BETA1**self.steps)
        for w, m, v, g in zip(self.weights, self.first, self.second, grads, strict=True):
            m += (1 - BETA1) * (g - m)
            v += (1 - BETA2) * (g * g - v)
            w -= rate[:, None, None] * m / (np.sqrt(v) + ADAM_EPS)


def risk_parts(p: np.ndarray, positive: np.ndarray, prior: np.ndarray, eps: float):
    """``risk, negative part`` per cell for probabilities (cells, rows)."""
    clipped = np.clip(p, eps, 1 - eps)
    n_p, n_u = max(positive.sum(), 1), max((~positive).sum(), 1)
    cost, gain = -np.log(1 - clipped), -np.log(clipped)
    negative = cost[:, ~positive].sum(axis=1) / n_u - prior * cost[:, positive].sum(axis=1) / n_p
    return prior * gain[:, positive].sum(axis=1) / n_p + np.maximum(0, negative), negative


def step(state: State, x: np.ndarray, positive: np.ndarray, eps: float) -> np.ndarray:
    """One Adam step of all cells on a mini-batch; the risks before it."""
    acts = state.forward(x)
    p = acts[-1][:, :, 0]
    risk, negative = risk_parts(p, positive, state.prior, eps)
    inside = (p > eps) & (p < 1 - eps)
    n_p, n_u = max(positive.sum(), 1), max((~positive).sum(), 1)
    counted = (negative > 0)[:, None]
    prior = state.prior[:, None]
    # slope of the risk in the last layer's input; a clipped loss has none
    on_p = prior / n_p * ((p - 1) - np.where(counted, p, 0.0))
    slope = np.where(positive, on_p, np.where(counted, p / n_u, 0.0)) * inside
    delta = slope[:, :, None]
    grads: list = [None] * len(state.weights)
    for i in range(len(state.weights) - 2, -1, -2):
        below = acts[i // 2]
        if i == 0:
            # one product for all cells, as in the forward pass
            flat = x.T @ delta.transpose(1, 0, 2).reshape(len(x), -1)
            grads[0] = flat.reshape(state.dim, state.cells, -1).transpose(1, 0, 2)
        else:
            grads[i] = below.transpose(0, 2, 1) @ delta
        grads[i + 1] = delta.sum(axis=1, keepdims=True)
        if i:
            delta = (delta @ state.weights[i].transpose(0, 2, 1)) * (below > 0)
    state.adam(grads)
    return risk


@dataclass(frozen=True)
class Settings:
    """What all cells of a stack share."""

    batch_rows: int = 32
    eps: float = 1e-7
    plateau: bool = False
    patience: int = 10
    factor: float = 0.1
    min_delta: float = 1e-4
    shuffle_seed: int = DEFAULT_SEED


def epoch(state: State, x, positive, x_val, positive_val, auto: np.ndarray, how: Settings, order: np.ndarray) -> np.ndarray:
    """One epoch over a block, in ``order``; ``risk, monitored, prior, rate`` per cell."""
    risks = []
    for at in range(0, len(order), how.batch_rows):
        pick = order[at : at + how.batch_rows]
        risks.append(step(state, x[pick], positive[pick], how.eps))
    risk = np.mean(risks, axis=0)
    monitored = risk
    if len(x_val):
        p = state.forward(x_val)[-1][:, :, 0]
        monitored, _ = risk_parts(p, positive_val, state.prior, how.eps)
        state.prior[auto] = (p[auto] > 0.5).mean(axis=1)
    if how.plateau:
        better = monitored < state.best - how.min_delta
        state.best[better] = monitored[better]
        state.wait[:] = np.where(better, 0, state.wait + 1)
        worn = state.wait >= how.patience
        state.rate[worn] *= how.factor
        state.wait[worn] = 0
    return np.stack([risk, monitored, state.prior, state.rate])


class StackedNonNegativePU:
    """Trains all ``cells`` together; ``models`` are the fitted classifiers, in their order."""

    def __init__(self, cells: Sequence[Cell], layer_sizes: Sequence[int] = (1,), epochs: int = 200,
                 epochs_per_job: int = 10, settings: Settings = Settings(), id_col: str = "vec_id"):
        self.cells, self.layer_sizes, self.epochs = list(cells), list(layer_sizes), epochs
        self.epochs_per_job, self.how, self.id_col = epochs_per_job, settings, id_col
        #: per epoch and cell: risk, monitored, prior, rate
        self.history = np.zeros((0, 4, len(self.cells)))
        self.jobs = 0

    def _blocks(self, train: DataFrame, val: DataFrame | None, features: str, y: str) -> DataFrame:
        rows = train.select(*[c for c in (self.id_col,) if c in train.columns], features, y)
        rows = rows.withColumn("held", F.lit(0))
        if val is not None:
            rows = rows.unionByName(val.select(*rows.columns[:-1]).withColumn("held", F.lit(1)))
        shards = max(1, -(-train.count() // SHARD_ROWS))
        seed = F.lit(self.how.shuffle_seed)
        named = [F.col(c) for c in (self.id_col,) if c in rows.columns]
        # the id deals the rows; equal rows stand next to each other, which is no matter
        key = F.xxhash64(seed, *(named or [F.col(features), F.col(y)]))
        place = F.struct(F.xxhash64(F.lit("place"), key), F.xxhash64(features, y))
        labels = F.array(F.col(y).cast("double"), F.col("held").cast("double"))
        return pack(rows, {"x": F.col(features), "y": labels}, 2 * SHARD_ROWS, (F.pmod(key, F.lit(shards)), place))

    def fit(self, train: DataFrame, val: DataFrame | None = None, features: str = "features", y: str = "y_pu"):
        blocks = self._blocks(train, val, features, y)
        head = blocks.select("n", "x").first()
        if head is None:
            raise ValueError("no rows to fit")
        dim, m = len(head["x"]) // (8 * head["n"]), len(self.cells)
        auto = np.array([c.prior == "auto" for c in self.cells])
        state = State(m, self.layer_sizes, dim)
        for j, cell in enumerate(self.cells):
            flat = [a for pair in initial_weights(self.layer_sizes, dim, cell.seed) for a in pair]
            for layer, values in zip(state.weights, flat, strict=True):
                layer[j] = values
            state.prior[j] = 0.5 if auto[j] else float(cell.prior)
            state.rate[j] = cell.learning_rate
        state.best[:] = 1e300
        tasks = blocks.rdd.getNumPartitions()
        self.jobs = 0
        for done in range(0, self.epochs, self.epochs_per_job):
            many = min(self.epochs_per_job, self.epochs - done)
            found = self._pass(blocks, state, auto, done, many, tasks)
            total = found[0]
            if not total:
                raise ValueError("no training rows")
            told = 4 * m * many
            self.history = np.concatenate([self.history, (found[1 : 1 + told] / total).reshape(many, 4, m)])
            state = State(m, self.layer_sizes, dim, found[1 + told :] / total)
            self.jobs += 1
        self.state = state
        self.models = [self._model(j) for j in range(m)]
        return self

    def _pass(self, blocks: DataFrame, state: State, auto: np.ndarray, done: int, many: int, tasks: int) -> np.ndarray:
        """Row-weighted sums of history and state over all blocks, behind the row count."""
        how = self.how
        shape = (state.cells, state.layer_sizes, state.dim)
        flat = state.flat

        def run(batches):
            total = np.zeros(1 + 4 * state.cells * many + len(flat))
            for batch in batches:
                shards = batch.column("shard").to_pylist()
                for shard, (_, x, labels) in zip(shards, unpack(batch, ["x", "y"]), strict=True):
                    held, positive = labels[:, 1] == 1, labels[:, 0] == 1
                    x_train, x_val = x[~held], x[held]
                    if not len(x_train):
                        continue
                    own = State(*shape, flat.copy())
                    told = []
                    for e in range(many):
                        order = np.random.default_rng([how.shuffle_seed, shard, done + e]).permutation(len(x_train))
                        told.append(epoch(own, x_train, positive[~held], x_val, positive[held], auto, how, order))
                    total += len(x_train) * np.concatenate([[1.0], np.ravel(told), own.flat])
            yield pa.RecordBatch.from_arrays(
                [pa.array([0], pa.int32()), pa.array([total.tobytes()], pa.binary())], ["one", "sums"]
            )

        parts = blocks.select("n", "shard", "x", "y").mapInArrow(run, "one int, sums binary")
        ((_, found),) = add_up(parts, tasks, "one", "sums", 8 * (1 + 4 * state.cells * many + len(flat)))
        return found

    def _model(self, j: int):
        from .models import NonNegativePU

        model = NonNegativePU(self.layer_sizes, self.cells[j].prior, self.epochs, self.cells[j].learning_rate, self.cells[j].seed)
        layers = self.state.weights
        model.weights = [(layers[i][j].copy(), layers[i + 1][j, 0].copy()) for i in range(0, len(layers), 2)]
        model.prior = float(self.state.prior[j])
        names = ("risk", "monitored", "prior", "lr")
        model.history = [
            {"epoch": e + 1, **{n: float(v) for n, v in zip(names, told[:, j], strict=True)}} for e, told in enumerate(self.history)
        ]
        return model
