"""Language-model scoring by a log-bilinear model (operator 2).

Corpus statistics cover all training texts and are gathered in Spark: the count of every
token, and the count of every pair of neighbouring symbols. A symbol is one of the
``WORDS`` most frequent tokens (the end of a text among them) or one of ``CLASSES``
classes of all other tokens, by a hash of their last bytes. A token's probability is that
of its symbol after the symbol before it, by the model, times, in a class, its share of
the class by counts (one added to each known token and to one unknown).

The model gives symbol w after symbol h the score ``(R[h] C) . Q[w] + b[w]``, with feature
vectors R and Q, a matrix C for the position and a bias, trained in numpy by
noise-contrastive estimation against the unigram distribution. Since all it needs of the
corpus are the pair counts, a table of at most ``(WORDS + CLASSES)**2`` entries whatever
the corpus, both expectations of the objective are summed over that table exactly instead
of being sampled. The normalised log-probabilities of all pairs are one batched matrix
product and a log-softmax; texts are scored by looking them up.

Token counts of the head (tokens with more than ``1 / HEAD`` of all training tokens, so
fewer than HEAD) go to the scoring tasks; occurrences of other tokens are joined with the
count table by token, so no count is ever left out.

Defined results: null text is empty and has the end token alone; a null id counts as the
text ``''`` in the split; repeated rows give repeated results; extra columns are ignored;
an empty table gives an empty result, and without training texts every token is unknown.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkpul.llm.common import in_slices, map_slices, materialize

#: the end token; no word holds white space
END = b"\n"
WORDS = 768
CLASSES = 256
CLASS_BYTES = 3
HEAD = 1 << 19
DIM = 32
NOISE = 8.0
#: pairs added to every symbol, spread as the unigram distribution: rare contexts stay near it
PRIOR = 20.0
ROUNDS = 250
RATE = 0.03
DECAY = 1e-7
FOLDS, HELD_OUT = 7, 2
#: distinct tokens counted in a task before they are passed on
HELD_TOKENS = 1 << 20

SCORED = (
    "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double, "
    "rare array<struct<token:binary,class:int,n:long>>"
)


def tokens(text: str | None) -> list[bytes]:
    found = (text or "").encode().lower().split()
    found.append(END)
    return found


def token_class(token: bytes) -> int:
    return xxhash.xxh64_intdigest(token[-CLASS_BYTES:], 42) % CLASSES


# -- counts ------------------------------------------------------------------------


def token_counts(texts: DataFrame) -> DataFrame:
    """``token, class, n`` over all texts (column ``text``)."""

    def run(batches):
        held: Counter = Counter()

        def out():
            return pa.RecordBatch.from_arrays(
                [
                    pa.array(list(held), pa.binary()),
                    pa.array([token_class(t) for t in held], pa.int32()),
                    pa.array(list(held.values()), pa.int64()),
                ],
                ["token", "class", "n"],
            )

        for piece in in_slices(batches, "text", 2 << 20):
            for text in piece.column(0).to_pylist():
                held.update(tokens(text))
            if len(held) > HELD_TOKENS:
                yield out()
                held.clear()
        yield out()

    counted = texts.select("text").mapInArrow(run, "token binary, class int, n long")
    return counted.groupBy("token", "class").agg(F.sum("n").alias("n"))


class Symbols(dict):
    """Symbol of a token: its own, or that of its class."""

    def __missing__(self, token: bytes) -> int:
        return WORDS + token_class(token)


def pair_counts(texts: DataFrame, words: list[bytes]) -> np.ndarray:
    """Counts of symbol pairs over all texts; a text begins after an end."""
    size = WORDS + CLASSES

    def run(batches):
        symbols = Symbols({w: i for i, w in enumerate(words)})
        total = np.zeros(size * size, np.int64)
        for piece in in_slices(batches, "text", 2 << 20):
            flat = [END]
            for text in piece.column(0).to_pylist():
                flat += tokens(text)
            ids = np.fromiter(map(symbols.__getitem__, flat), np.int64, len(flat))
            total += np.bincount(ids[:-1] * size + ids[1:], minlength=size * size)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], ["pair", "n"])

    found = texts.select("text").mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))
    rows = found.toPandas()  # at most (WORDS + CLASSES)**2 rows
    out = np.zeros(size * size, np.float32)
    out[rows["pair"].to_numpy(int)] = rows["n"].to_numpy()
    return out.reshape(size, size)


# -- model -------------------------------------------------------------------------


def train(pairs: np.ndarray, rounds: int = ROUNDS, dim: int = DIM, seed: int = 7) -> np.ndarray:
    """Fit the model to pair counts; ``log10 P(w | h)`` of all symbols, normalised.

    Maximises ``sum n(h, w) log s(x) + k n(h) q(w) log s(-x)`` with
    ``x = score(h, w) - log(k q(w))``, s the logistic function and q the unigram
    distribution: noise-contrastive estimation with its expectations in closed form.
    """
    size = len(pairs)
    rng = np.random.default_rng(seed)
    total = max(float(pairs.sum()), 1.0)
    unigram = (pairs.sum(axis=0) + 0.5) / (total + 0.5 * size)
    pairs = pairs + PRIOR * (pairs.sum(axis=1, keepdims=True) > 0) * unigram
    total = max(float(pairs.sum()), 1.0)
    log_noise = np.log(NOISE * unigram).astype(np.float32)
    data = (pairs / total).astype(np.float32)
    noise = np.outer(pairs.sum(axis=1) / total, NOISE * unigram).astype(np.float32)
    weights = [
        rng.normal(0, 0.1, (size, dim)).astype(np.float32),
        np.eye(dim, dtype=np.float32),
        rng.normal(0, 0.1, (size, dim)).astype(np.float32),
        np.log(unigram).astype(np.float32),
    ]
    first, second = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights]
    for step in range(1, rounds + 1):
        r, c, q, b = weights
        context = r @ c
        x = context @ q.T + b - log_noise
        s = 1 / (1 + np.exp(-np.clip(x, -30, 30)))
        slope = data * (1 - s) - noise * s
        along = slope @ q
        grads = [along @ c.T - DECAY * r, r.T @ along, slope.T @ context - DECAY * q, slope.sum(axis=0)]
        rate = RATE * min(1.0, 2 * (1 - (step - 1) / rounds))
        for w, g, m, v in zip(weights, grads, first, second, strict=True):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            w += rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-9)
    r, c, q, b = weights
    scores = ((r @ c) @ q.T + b).astype(np.float64)
    top = scores.max(axis=1, keepdims=True)
    return ((scores - top - np.log(np.exp(scores - top).sum(axis=1, keepdims=True))) / np.log(10)).astype(np.float32)


# -- scores ------------------------------------------------------------------------


def score_documents(docs: DataFrame) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` of every document."""
    spark = docs.sparkSession
    fold = F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(FOLDS))
    docs = docs.select(F.col("doc_id").cast("long"), (fold == HELD_OUT).alias("held_out"), "text")
    training = docs.where("not held_out")

    counts = materialize(token_counts(training), "token-counts")
    n_all, n_distinct = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    per_class = np.ones(CLASSES)
    for row in counts.groupBy("class").agg(F.sum(F.col("n") + 1).alias("n")).collect():  # one row per class
        per_class[row["class"]] += row["n"]
    is_head = F.col("n") > n_all / HEAD  # fewer than HEAD tokens, since counts sum to n_all
    head = counts.where(is_head).select("token", "class", "n").toArrow()
    order = sorted(zip((-n for n in head["n"].to_pylist()), head["token"].to_pylist(), strict=True))
    words = [t for _, t in order[:WORDS]]
    model_words = set(words)
    head_tokens, head_n = head["token"].to_pylist(), np.array(head["n"].to_pylist(), np.int64)
    head_class = np.array(head["class"].to_pylist(), np.int64)
    in_model = np.array([t in model_words for t in head_tokens], bool)
    np.subtract.at(per_class, head_class[in_model], head_n[in_model] + 1)

    log_probs = train(pair_counts(training, words))
    place = {w: i for i, w in enumerate(words)}
    own_symbol = np.where(in_model, [place.get(t, -1) for t in head_tokens], WORDS + head_class).astype(np.int32)
    share = np.where(in_model, 0.0, np.log10(head_n + 1) - np.log10(per_class[head_class]))
    log_all = float(np.log10(n_all + n_distinct + 1))
    shared = spark.sparkContext.broadcast({  # at most HEAD tokens and the fixed table of pairs
        "head": {t: i for i, t in enumerate(head_tokens)},
        "base": np.log10(head_n + 1) - log_all, "share": share, "symbol": own_symbol, "pairs": log_probs,
        "end": place.get(END, WORDS + token_class(END)),
    })

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        model = shared.value
        look = Head(model["head"])
        n = len(model["base"])
        rows = []
        for doc_id, held_out, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            words = tokens(text)
            at = np.fromiter(map(look.__getitem__, words), np.int64, len(words))
            common = at[at >= 0]
            symbol = WORDS - 1 - at
            symbol[at >= 0] = model["symbol"][common] if n else symbol[at >= 0]
            before = np.concatenate([[model["end"]], symbol[:-1]])
            rare = Counter((words[i], -1 - int(at[i])) for i in np.flatnonzero(at < 0))
            rows.append((
                doc_id, held_out, len(words), len(common), float(model["base"][common].sum()) if n else 0.0,
                float(model["pairs"][before, symbol].sum(dtype=np.float64)) + (float(model["share"][common].sum()) if n else 0.0),
                [{"token": t, "class": c, "n": k} for (t, c), k in rare.items()],
            ))
        return pa.RecordBatch.from_arrays(
            [pa.array(x, kind) for x, kind in zip(zip(*rows, strict=True), KINDS, strict=True)], names=NAMES
        )

    scored = map_slices(docs, run, SCORED).withColumn("row", F.monotonically_increasing_id())
    scored = materialize(scored, "scored")
    rare = scored.select("row", F.explode("rare").alias("r")).select("row", "r.token", "r.class", "r.n")
    known = counts.where(~is_head).select(F.col("token").alias("known"), F.col("n").alias("count"))
    joined = rare.join(known, F.col("token") == F.col("known"), "left")
    of_class = F.array(*[F.lit(float(x)) for x in np.log10(per_class)])
    seen = F.log10(F.coalesce("count", F.lit(0)) + 1)
    more = joined.groupBy("row").agg(
        F.sum(F.when(F.col("count").isNotNull(), F.col("n")).otherwise(0)).alias("more_known"),
        F.sum(F.col("n") * (seen - log_all)).alias("more_base"),
        F.sum(F.col("n") * (seen - F.get(of_class, F.col("class")))).alias("more_score"),
    )
    return scored.drop("rare").join(more, "row", "left").select(
        "doc_id", "held_out", "n_tokens",
        (F.col("n_known") + F.coalesce("more_known", F.lit(0))).alias("n_known"),
        F.lit(int(n_all)).cast("long").alias("train_tokens"),
        (F.col("base_score") + F.coalesce("more_base", F.lit(0.0))).alias("base_score"),
        (F.col("score") + F.coalesce("more_score", F.lit(0.0))).alias("score"),
    )


class Head(dict):
    """Place of a head token; for any other ``-1 - class``."""

    def __missing__(self, token: bytes) -> int:
        return -1 - token_class(token)


NAMES = ["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score", "rare"]
KINDS = [
    pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64(),
    pa.list_(pa.struct([("token", pa.binary()), ("class", pa.int32()), ("n", pa.int64())])),
]
