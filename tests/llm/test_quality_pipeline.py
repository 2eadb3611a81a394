"""Operator 3 on held-out documents, and the pipeline against plain Python."""

from __future__ import annotations

import hashlib
import zlib
from collections import Counter

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken

import __spark_entry__ as entry
import corpus_pipeline
from sparkpul.llm import bpe, quality, secrets
from tests.llm.fixtures import ROWS, docs
from tests.llm.test_native import base_spans
from tests.llm.test_text_operators import grams, plain_components, plain_simhash

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def tables(spark):
    read = lambda name: spark.read.parquet(f"{SF}/{name}.parquet")
    return read("documents"), read("labels")


def test_op3_on_held_out_documents(spark, tables):
    found = {r["doc_id"]: r for r in quality.score_documents(*tables).collect()}
    labels = {r["doc_id"]: r["quality"] for r in tables[1].collect()}
    assert len(found) == tables[0].count()
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in found.items())
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in found.values())
    held = [(found[i]["score"], y) for i, y in labels.items() if found[i]["held_out"]]
    good, bad = [s for s, y in held if y == 1], [s for s, y in held if y == 0]
    auc = np.mean([(g > b) + 0.5 * (g == b) for g in good for b in bad])
    assert auc > 0.95
    assert np.mean([s >= 0.3 for s in good]) > 0.97


def test_op3_uses_the_text_alone(spark, tables):
    """Equal texts have equal scores whatever their other columns."""
    network = quality.train(*tables, steps=50)
    scored = quality.with_scores(docs(spark), network, "p").collect()
    by_text = {}
    for r in scored:
        by_text.setdefault(r["text"] or "", set()).add(r["p"])
    assert len(scored) == len(ROWS) and all(len(x) == 1 for x in by_text.values())


def test_op3_whole_texts():
    """A change anywhere in a long text reaches its score."""
    network = quality.Network()
    base = bytes(97 + i % 23 for i in range(5000))
    plain = network.scores([base])[0]
    for at in (0, 600, 2500, 4300, 4970):
        assert network.scores([base[:at] + b"\xff" * 30 + base[at + 30 :]])[0] != plain
    n = quality.CHUNK + quality.WIDTH - 1
    for size in (0, 1, n - 1, n, n + 1, 3 * n):
        cut = quality.chunks(bytes(range(1, 251)) * 7 if size > 250 else b"x" * size)
        assert cut.shape[1] == n
    windows = {tuple(c[i : i + quality.WIDTH]) for c in quality.chunks(base) for i in range(quality.CHUNK)}
    assert windows == {tuple(base[i : i + quality.WIDTH]) for i in range(len(base) - quality.WIDTH + 1)}


def test_op3_gradient():
    """The training step's gradient agrees with finite differences."""
    rng = np.random.default_rng(1)
    rows = rng.integers(0, 256, (4, quality.CHUNK + quality.WIDTH - 1)).astype(np.int16)
    labels = np.array([0.0, 1.0, 1.0, 0.0])

    def loss(net):
        best, _ = net.pooled(rows, net.tables().astype(np.float64))
        odds = net.log_odds(best.astype(np.float64))
        return float(np.sum(np.logaddexp(0, odds) - labels * odds))

    net = quality.Network()
    before = loss(net)
    net.fit(np.repeat(rows, 16, axis=0), np.repeat(labels, 16), steps=40)
    assert loss(net) < 0.7 * before


def plain_score(network, data):
    """The forward pass in plain loops: byte vectors, filters, best of each chunk, mean of log-odds."""
    w = network.weights
    n = quality.CHUNK + quality.WIDTH - 1
    symbols = list(data) + [quality.PAD] * max(0, n - len(data))
    starts = [0] if len(data) <= n else [*range(0, len(data) - n, quality.CHUNK), len(data) - n]
    odds = []
    for a in starts:
        best = [-np.inf] * quality.FILTERS
        for i in range(a, a + quality.CHUNK):
            answer = sum(w["bytes"][symbols[i + j]] @ w["filters"][j] for j in range(quality.WIDTH))
            best = [max(b, x) for b, x in zip(best, answer)]
        odds.append(sum(np.tanh(b + s) * t for b, s, t in zip(best, w["shift"], w["top"])) + w["bias"][0])
    return 1 / (1 + np.exp(-sum(odds) / len(odds)))


def test_op3_forward_pass():
    network = quality.Network(3)
    rng = np.random.default_rng(2)
    network.weights["shift"][:] = rng.normal(size=quality.FILTERS)
    network.weights["bias"][0] = 0.3
    texts = [b"", b"x", "caf\u00e9 ".encode() * 30, bytes(rng.integers(0, 256, 517)), bytes(rng.integers(0, 256, 518)), b"ab" * 700]
    got = network.scores(texts)
    assert np.allclose(got, [plain_score(network, t) for t in texts], atol=1e-4)


def test_op3_document_gradient():
    """One step's direction is that of the loss of documents with several chunks."""
    rng = np.random.default_rng(1)
    counts = np.array([1, 3, 2])
    rows = rng.integers(0, 256, (6, quality.CHUNK + quality.WIDTH - 1)).astype(np.int16)
    labels = np.array([0.0, 1.0, 0.0])

    def loss(net):
        best, _ = net.pooled(rows, net.tables().astype(np.float64))
        odds = np.add.reduceat(net.log_odds(best.astype(np.float64)), np.cumsum(counts) - counts) / counts
        return float(np.sum(np.logaddexp(0, odds) - labels * odds))

    net = quality.Network()
    net.fit(rows, labels, steps=0, counts=counts)
    before = loss(net)
    net.fit(rows, labels, steps=40, counts=counts)
    assert loss(net) < 0.5 * before


def test_op3_sample(spark):
    """Only documents that are there, one text per id, within both bounds, whole texts."""
    rows = [(i, "text %d " % i + "x" * (3000 if i == 5 else 10 * i), "en", "s") for i in range(60)]
    rows += [(7, "another text of seven", "en", "s")] * 50 + [(None, "no id", "en", "s")]
    frame = docs(spark, rows)
    labels = spark.createDataFrame([(i, i % 2) for i in range(500)], "doc_id long, quality int")
    every = {r["id"]: r["text"] for r in quality._sample(frame, labels, 4000, 1 << 20).collect()}
    fold = lambda i: __import__("zlib").crc32(str(i).encode()) % 5
    assert every.keys() == {i for i in range(60) if fold(i)}
    assert all(t in {r[1] for r in rows if r[0] == i} for i, t in every.items())
    some = quality._sample(frame, labels, 20, 1 << 20).collect()
    assert len(some) == 20 and {r["id"] for r in some} <= every.keys()
    small = quality._sample(frame, labels, 4000, 2000).collect()
    assert 0 < sum(len(r["text"]) for r in small) <= 2000 and len(small) < len(every)


def test_op3_odd_labels(spark):
    frame = docs(spark)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r["score"] for r in quality.score_documents(frame, none).collect()} == {0.5}
    odd = spark.createDataFrame([(1, 1, 0), (4, None, 0), (None, 0, 0), (999, 0, 0), (5, 1, 0), (5, 1, 1)],
                                "doc_id long, quality int, toxic int")
    assert quality.score_documents(frame, odd).count() == len(ROWS)
    assert quality.score_documents(docs(spark, []), odd).count() == 0


def test_pipeline(spark, tables):
    """Every stage on the whole table, against plain Python from the classifier's scores on."""
    network = quality.train(*tables)
    rows = [(r["doc_id"], r["text"]) for r in tables[0].collect()]
    rows = [(i, t) for i, t in rows if network.scores([(t or "").encode()])[0] >= 0.3]
    least = plain_components([(i, plain_simhash(t)) for i, t in rows])
    stay = {i for i, _, c in least if i == c}
    rows = [(i, t) for i, t in rows if i in stay]
    items = [grams(r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    rows = [(i, t) for i, t in rows if not any(q and len(q & g) >= 0.8 * len(q) for g in [grams(t)] for q in items)]
    library = tiktoken.Encoding(
        "own", pat_str=P.PATTERN, mergeable_ranks=bpe.encoder(P.path(bpe.RANK_FILE), P.PATTERN).table.ranks, special_tokens={}
    )
    want = Counter()
    for i, t in rows:
        out, at = "", 0
        for a, _, b in base_spans(t):
            if a >= at:
                out += t[at:a] + secrets.MASK
            at = max(at, b)
        out += t[at:]
        ids = library.encode_ordinary(out)
        want[i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(),
             hashlib.sha256(out.encode()).hexdigest()] += 1
    got = corpus_pipeline.run(spark, SF).drop("token_ids")
    assert Counter(tuple(r) for r in got.collect()) == want


def test_stages_keep_the_columns_and_stand_odd_rows(spark):
    frame = docs(spark)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, frame, SF)
        assert out.columns == frame.columns, name
        assert out.count() <= len(ROWS)
        assert stage(spark, docs(spark, []), SF).count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, frame, SF).count() == len(ROWS)


def test_registered():
    names = set(entry.queries())
    assert "pipeline" in names
    for n in range(1, 11):
        assert len([x for x in names if x.startswith(f"op{n}_")]) == 1
