"""Operator 5 against brute force over all windows, and its suffix arrays against sorting."""

from __future__ import annotations

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkpul.llm import suffix_dedup as sd
from sparkpul.llm.suffix_sort import suffix_arrays
from tests.llm.fixtures import ROWS, bag, docs


def brute(texts: list[bytes], length: int) -> list[tuple]:
    seen = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        gone = np.zeros(len(t) + 1, bool)
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                gone[i : i + length] = True
        gone[len(t)] = False
        runs = int((np.diff(np.concatenate([[0], gone.view(np.int8)])) > 0).sum())
        kept = bytes(b for b, g in zip(t, gone, strict=False) if not g)
        out.append((len(t), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest()))
    return out


def want(rows, length):
    texts = [(r[1] or "").encode() for r in rows]
    return Counter((r[0], *x) for r, x in zip(rows, brute(texts, length), strict=True))


def repeated_rows(seed=3, vocabulary=60, passages=8, documents=60, edits=6):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdeé") for _ in range(rng.randrange(1, 7))) for _ in range(vocabulary)]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    shared = [text(rng.randrange(10, 80)) for _ in range(passages)]
    rows = list(ROWS)
    for i in range(documents):
        parts = [text(rng.randrange(0, 60))]
        for _ in range(rng.randrange(4)):
            w = rng.choice(shared).split()
            for _ in range(rng.randrange(edits) if rng.random() < 0.5 else 0):
                w[rng.randrange(len(w))] = rng.choice(words)
            parts += [" ".join(w), text(rng.randrange(0, 40))]
        rows.append((100 + i, " ".join(parts), "en", "s"))
    rows += [(900, "xyz" * 200, "en", "s"), (901, "é" * 150, "en", "s"), (902, rows[-3][1], "en", "s")]
    rows.append(rows[-4])
    return rows


@pytest.mark.parametrize(("length", "gram", "bucket"), [(40, 10, 1 << 15), (40, 10, 300), (40, 10, 1), (101, 33, 500)])
def test_op5(spark, monkeypatch, length, gram, bucket):
    """Equal to brute force, with buckets whole and split down to single windows."""
    monkeypatch.setattr(sd, "BUCKET_BYTES", bucket)
    rows = repeated_rows()
    got = bag(sd.digests(sd.remove_repeats(docs(spark, rows), length, gram)))
    assert got == want(rows, length)
    assert sum(k[3] > 0 for k in got) > 20


def test_op5_production_parameters(spark):
    rows = repeated_rows(seed=8, vocabulary=2000, documents=40, edits=3)
    long = "".join(random.Random(1).choice("abcdefgh ") for _ in range(3000))
    rows += [(2000, long, "en", "s"), (2001, "x" + long[500:1500], "en", "s"), (2002, long[:450] + "y" + long[451:], "en", "s")]
    assert bag(sd.digests(sd.remove_repeats(docs(spark, rows)))) == want(rows, 400)


def test_op5_empty_table(spark):
    assert sd.remove_repeats(docs(spark, [])).count() == 0


def test_suffix_arrays():
    rng = random.Random(1)
    for trial in range(150):
        texts = [
            [rng.randint(1, rng.choice([2, 3, 200])) for _ in range(rng.randrange(rng.choice([3, 40, 120])))] + [0]
            for _ in range(rng.randrange(1, 8))
        ]
        if trial % 5 == 0:
            texts = [[1] * rng.randrange(1, 50) + [0], [1, 2] * rng.randrange(1, 40) + [0], [2, 1, 1] * 20 + [0]]
        starts = np.cumsum([0] + [len(t) for t in texts])
        got = suffix_arrays(np.array(sum(texts, []), np.int32), starts)
        for t, s in zip(texts, starts, strict=False):
            assert (got[s : s + len(t)] - s).tolist() == sorted(range(len(t)), key=lambda i: t[i:])


def test_anchors_are_leftmost_least():
    rng = np.random.default_rng(0)
    values = rng.integers(0, 2**63, 500, dtype=np.uint64)
    values[100:140] = values[100]
    for width in (1, 2, 7, 500):
        got = sd.least_places(values, width)
        high = values >> np.uint64(32)
        assert got.tolist() == [s + int(np.argmin(high[s : s + width])) for s in range(500 - width + 1)]


def test_op5_tasks_get_buckets_of_like_size(spark, monkeypatch):
    """A batch is sorted until its largest bucket is done: small buckets do not share a task
    with large ones, and tasks are as many as fill a batch."""
    rng = random.Random(5)
    rows = []
    for key in range(120):
        core = rng.randbytes(40 if key % 6 else 400)
        strings = [core + rng.randbytes(10), core + rng.randbytes(10)]
        rows += [(key, 2 * key + i, 0, 0, 0, 1, sum(map(len, strings)), s) for i, s in enumerate(strings)]
    rows += rows[:4]  # the strings of equal rows
    strings = spark.createDataFrame(rows, sd.CUT)
    spans = sd.bucket_spans(strings, 40, 4).withColumn("task", F.spark_partition_id()).collect()
    assert {(r.doc_id, r.a, r.b) for r in spans} == {(d, 0, 400 if k % 6 == 0 else 40) for k, d, *_ in rows}
    assert len(spans) == 240
    tasks = {large: {r.task for r in spans if (r.b == 400) == large} for large in (False, True)}
    assert len(tasks[False]) > 1 and len(tasks[False] & tasks[True]) <= 1

    dealt = []
    whole = sd.bucket_spans
    monkeypatch.setattr(sd, "bucket_spans", lambda s, length, n: dealt.append(n) or whole(s, length, n))
    rows = repeated_rows()
    assert bag(sd.digests(sd.remove_repeats(docs(spark, rows), 40, 10))) == want(rows, 40)
    assert dealt == [1]
