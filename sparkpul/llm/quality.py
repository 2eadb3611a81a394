"""Quality classifier: a convolutional network over bytes, in numpy (operator 3).

A document is cut into chunks of ``CHUNK`` places that overlap by a filter's width less
one, so every run of ``WIDTH`` bytes of the whole text lies in a chunk; the last chunk
ends with the text. Bytes have learned vectors; each of ``FILTERS`` filters responds to
``WIDTH`` bytes in a row; a chunk keeps each filter's largest response, and a layer on
top gives the chunk's log-odds. The document's probability is the logistic function of
the mean log-odds of its chunks, so neither length nor position weighs.

Scoring needs no multiplication with byte vectors: a filter's response is the sum of one
entry per byte from ``WIDTH`` tables of 257 rows, taken in blocks that stay in cache.

Training runs on the driver on a bounded sample of the labelled documents that are there:
at most ``sample`` of them and at most ``sample_bytes`` of text (no text of more than a
sixteenth of that), the first by a hash of their id. Every chunk of a sampled text takes part; the loss is that of the document's
probability, as it is scored. Scores depend on the text alone.

Defined results: null and empty texts are one chunk of padding; labels that are null, or
of unknown documents, are ignored, and of several labels of a document the least counts,
of several texts of a labelled id that with the least hash;
a null id counts as the text ``''`` in the split; without labels of both kinds the score
is the share of label 1 (0.5 without any); repeated rows give repeated results; an empty
table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkpul.llm.common import free_name, map_slices

CHUNK = 512
WIDTH = 6
FILTERS = 24
DIM = 8
#: bounds of the training sample: documents, and bytes of their texts
SAMPLE = 4000
SAMPLE_BYTES = 24 << 20
STEPS = 1500
#: documents of a training step
BATCH = 24
RATE = 0.01
FOLDS, HELD_OUT = 5, 0
THRESHOLD = 0.3
#: the symbol after the end of a text
PAD = 256
#: chunks whose responses are computed at a time
BLOCK = 32


def chunks(data: bytes) -> np.ndarray:
    """All chunks of a text as rows of symbols."""
    size = CHUNK + WIDTH - 1
    symbols = np.frombuffer(data, np.uint8).astype(np.int16)
    n = len(symbols)
    if n <= size:
        return np.concatenate([symbols, np.full(size - n, PAD, np.int16)])[None]
    starts = np.append(np.arange(0, n - size, CHUNK), n - size)
    return symbols[starts[:, None] + np.arange(size)]


class Network:
    """Byte vectors, filters and the layer on top."""

    def __init__(self, seed: int = 11):
        rng = np.random.default_rng(seed)
        self.weights = {
            "bytes": rng.normal(0, 0.5, (PAD + 1, DIM)),
            "filters": rng.normal(0, (WIDTH * DIM) ** -0.5, (WIDTH, DIM, FILTERS)),
            "shift": np.zeros(FILTERS),
            "top": rng.normal(0, 0.3, FILTERS),
            "bias": np.zeros(1),
        }

    def tables(self) -> np.ndarray:
        """Response of every filter to every symbol at every place of its width."""
        w = self.weights
        return np.einsum("sd,jdf->jsf", w["bytes"], w["filters"]).astype(np.float32)

    def pooled(self, rows: np.ndarray, tables: np.ndarray, places: bool = False):
        """Largest response of each filter in each chunk, and with ``places`` where it is."""
        best = np.empty((len(rows), FILTERS), np.float32)
        where = np.empty((len(rows), FILTERS), np.int64) if places else None
        for at in range(0, len(rows), BLOCK):
            block = rows[at : at + BLOCK]
            total = np.take(tables[0], block[:, :CHUNK], axis=0)
            for j in range(1, WIDTH):
                total += np.take(tables[j], block[:, j : j + CHUNK], axis=0)
            if places:
                where[at : at + BLOCK] = total.argmax(axis=1)
            best[at : at + BLOCK] = total.max(axis=1)
        return best, where

    def log_odds(self, best: np.ndarray) -> np.ndarray:
        w = self.weights
        return np.tanh(best + w["shift"]) @ w["top"] + w["bias"][0]

    def fit(
        self, rows: np.ndarray, labels: np.ndarray, steps: int = STEPS, seed: int = 5, counts: np.ndarray | None = None
    ) -> Network:
        """Adam on the log loss of documents: ``labels`` has one entry per document,
        ``counts`` its chunks in ``rows``, one each by default."""
        rng = np.random.default_rng(seed)
        counts = np.ones(len(rows), np.int64) if counts is None else counts
        starts = np.cumsum(counts) - counts
        w = self.weights
        w["bias"][0] = np.log((labels.mean() + 1e-3) / (1 - labels.mean() + 1e-3))
        first = {k: np.zeros_like(v) for k, v in w.items()}
        second = {k: np.zeros_like(v) for k, v in w.items()}
        j = np.arange(WIDTH)
        for step in range(1, steps + 1):
            pick = rng.integers(0, len(labels), BATCH)
            many = counts[pick]
            batch = rows[np.concatenate([np.arange(starts[i], starts[i] + counts[i]) for i in pick])]
            best, where = self.pooled(batch, self.tables(), places=True)
            h = np.tanh(best + w["shift"])
            mean = np.add.reduceat(h @ w["top"] + w["bias"][0], np.cumsum(many) - many) / many
            # each chunk has its share in the document's log-odds
            slope = np.repeat((1 / (1 + np.exp(-mean)) - labels[pick]) / (BATCH * many), many)
            back = slope[:, None] * w["top"] * (1 - h * h)
            # symbols under the place of each chunk's and filter's largest response
            seen = batch[np.arange(len(batch))[:, None, None], where[:, :, None] + j]
            grads = {
                "top": h.T @ slope, "bias": np.array([slope.sum()]), "shift": back.sum(axis=0),
                "filters": np.einsum("bf,bfjd->jdf", back, w["bytes"][seen]),
                "bytes": np.zeros_like(w["bytes"]),
            }
            np.add.at(grads["bytes"], seen, back[:, :, None, None] * w["filters"].transpose(2, 0, 1)[None])
            rate = RATE * (1 - (step - 1) / steps)
            for k, g in grads.items():
                g = g + 1e-5 * w[k]
                first[k] += 0.1 * (g - first[k])
                second[k] += 0.005 * (g * g - second[k])
                w[k] -= rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.995**step)) + 1e-8)
        return self

    def scores(self, texts: list[bytes]) -> np.ndarray:
        """Probability of label 1 of each text."""
        cut = [chunks(t) for t in texts]
        best, _ = self.pooled(np.concatenate(cut), self.tables())
        odds = self.log_odds(best)
        ends = np.cumsum([len(c) for c in cut])
        mean = np.add.reduceat(odds, ends - [len(c) for c in cut]) / [len(c) for c in cut]
        return 1 / (1 + np.exp(-mean))


def _fold(doc_id) -> F.Column:
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(FOLDS))


def _sample(docs: DataFrame, labels: DataFrame, sample: int, sample_bytes: int) -> DataFrame:
    """``id, text, label`` of the training sample: one text per labelled id that is there,
    the first by a hash of the id within both bounds."""
    known = labels.where("quality is not null and doc_id is not null").where(_fold(F.col("doc_id")) != HELD_OUT)
    known = known.groupBy(F.col("doc_id").cast("long").alias("id")).agg(F.min("quality").cast("int").alias("label"))
    text = F.coalesce("text", F.lit(""))
    read = docs.select(F.col("doc_id").cast("long").alias("id"), F.xxhash64(text).alias("h"), text.alias("text"))
    # what is shuffled has no texts, and a repeated id is one row
    there = read.select("id", F.struct("h", F.octet_length("text").alias("size")).alias("t")).where("id is not null")
    there = there.groupBy("id").agg(F.min("t").alias("t"))
    order = [F.xxhash64("id"), F.col("id")]
    there = there.where(F.col("t.size") <= sample_bytes // 16)  # one text alone must not use up the bound
    first = known.join(there, "id").orderBy(*order).limit(sample)  # the bound holds for any number of labels
    so_far = F.sum("t.size").over(Window.orderBy(*order))  # over at most ``sample`` rows
    chosen = first.withColumn("so_far", so_far).where(F.col("so_far") <= sample_bytes).select("id", "t.h", "label")
    found = read.join(F.broadcast(chosen), ["id", "h"])  # at most ``sample`` rows of three numbers
    return found.groupBy("id").agg(F.min("label").alias("label"), F.min("text").alias("text"))


def train(
    docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, steps: int = STEPS, sample_bytes: int = SAMPLE_BYTES
) -> Network:
    """Fit a network on at most ``sample`` labelled documents, of at most ``sample_bytes``
    bytes together, outside the held-out fold."""
    got = sorted((r["id"], r["label"], r["text"].encode()) for r in _sample(docs, labels, sample, sample_bytes).collect())
    network = Network()
    marks = np.array([label for _, label, _ in got], np.float64)
    if len(set(marks)) < 2:
        share = marks.mean() if len(marks) else 0.5
        network.weights["top"][:] = 0
        network.weights["bias"][0] = np.log((share + 1e-3) / (1 - share + 1e-3)) if len(marks) else 0.0
        return network
    cut = [chunks(data) for _, _, data in got]
    return network.fit(np.concatenate(cut), marks, steps, counts=np.array([len(c) for c in cut]))


def with_scores(docs: DataFrame, network: Network, name: str = "score") -> DataFrame:
    """``docs`` with a column ``name``: the probability of good quality of every whole text."""
    from pyspark.sql.types import DoubleType, StructType

    schema = StructType([*docs.schema.fields]).add(name, DoubleType())
    at = docs.columns.index("text")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = network.scores([(t or "").encode() for t in batch.column(at).to_pylist()])
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array(found)], [*batch.schema.names, name])

    return map_slices(docs, run, schema, budget=1 << 20)


def score_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every document."""
    own = docs.select("doc_id", "text")
    scored = with_scores(own, train(docs, labels))
    return scored.select(
        "doc_id", (_fold(F.col("doc_id")) == HELD_OUT).alias("held_out"), "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` without those scored under ``threshold``; columns as they are. No shuffle."""
    name = free_name(docs, "quality")
    scored = with_scores(docs, train(docs, labels), name)
    return scored.where(F.col(name) >= threshold).drop(name)
