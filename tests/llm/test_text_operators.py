"""Operators 1, 2, 6 and 10 against brute force over small fixtures."""

from __future__ import annotations

import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from sparkpul.llm import components, decontaminate, fingerprints, lm, simhash
from tests.llm.fixtures import ROWS, bag, docs


def words(text):
    return (text or "").encode().lower().split()


# -- operator 1 --------------------------------------------------------------------


def plain_simhash(text, k=3):
    w = words(text)
    if not w:
        return 0
    grams = [b" ".join(w[i : i + k]) for i in range(len(w) - k + 1)] if len(w) >= k else [b" ".join(w)]
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(prints, bits=3):
    """Least id reachable, for a list of (id, fingerprint)."""
    group = list(range(len(prints)))

    def find(i):
        while group[i] != i:
            i = group[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i][1] ^ prints[j][1]).bit_count() <= bits:
                group[find(i)] = find(j)
    least = {}
    for i, (doc, _) in enumerate(prints):
        if doc is not None:
            least[find(i)] = min(doc, least.get(find(i), doc))
    return Counter((doc, f"{fp:016x}", least.get(find(i))) for i, (doc, fp) in enumerate(prints))


def near_rows():
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(300)]
    rows = list(ROWS)
    for g in range(12):
        base = [rng.choice(vocabulary) for _ in range(400)]
        for c in range(8):
            text = list(base)
            for _ in range(c):
                text[rng.randrange(400)] = rng.choice(vocabulary)
            rows.append((1000 + 10 * g + c, " ".join(text).title(), "en", "s"))
    return rows


def test_op1(spark):
    rows = near_rows()
    want = plain_components([(r[0], plain_simhash(r[1])) for r in rows])
    got = bag(simhash.digests(simhash.near_duplicates(docs(spark, rows))))
    assert got == want
    assert len({k[2] for k in want}) < len(want) - 20
    assert simhash.near_duplicates(docs(spark, [])).count() == 0


@pytest.mark.parametrize("cell", [1, 3, 64])
def test_links_of_dense_groups(spark, cell):
    """All links, whether crowded cells are split or not."""
    rng = random.Random(2)
    base = rng.getrandbits(64)
    fps = {rng.getrandbits(64) for _ in range(100)} | {0, 1}
    for _ in range(150):
        fp = base
        for _ in range(rng.randrange(5)):
            fp ^= 1 << rng.randrange(64)
        fps.add(fp)
    fps = sorted(fps)
    want = {frozenset((a, b)) for a in fps for b in fps if a < b and (a ^ b).bit_count() <= 3}
    frame = spark.createDataFrame([(simhash._signed(f),) for f in fps], "fp long")
    found = simhash.linked(frame, cell=cell).collect()
    got = {frozenset((r["u"] % 2**64, r["v"] % 2**64)) for r in found}
    assert got == want and len(found) == len(want)


def test_drop_near_duplicates(spark):
    rows = near_rows()
    want = plain_components([(r[0], plain_simhash(r[1])) for r in rows])
    kept = Counter(k[0] for k, n in want.items() if k[0] is None or k[0] == k[2] for _ in range(n))
    frame = docs(spark, rows)
    got = simhash.drop_near_duplicates(frame)
    assert got.columns == frame.columns
    assert Counter(r[0] for r in got.select("doc_id").collect()) == kept


def test_components_of_long_paths(spark):
    edges = [(i, i + 1) for i in range(200)] + [(500, 400), (400, 600), (400, 400)]
    got = {r["u"]: r["v"] for r in components.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**{i: 0 for i in range(1, 201)}, 500: 400, 600: 400}


# -- operator 2 --------------------------------------------------------------------


def test_op2_base(spark):
    rows = near_rows()
    got = lm.score_documents(docs(spark, rows)).collect()
    held = {}
    counts = Counter()
    for r in rows:
        out = zlib.crc32(str("" if r[0] is None else r[0]).encode()) % 7 == 2
        held[r[0]] = out
        if not out:
            counts.update(words(r[1]))
            counts["end"] += 1
    n, v = sum(counts.values()), len(counts)
    want = Counter()
    for r in rows:
        t = [*words(r[1]), "end"]
        base = sum(math.log10((counts[x] + 1) / (n + v + 1)) for x in t)
        want[r[0], held[r[0]], len(t), sum(counts[x] > 0 for x in t), n, round(base, 6)] += 1
    assert Counter((*tuple(r)[:5], round(r["base_score"], 6)) for r in got) == want
    assert all(r["score"] < 0 for r in got)


def test_op2_rare_tokens_are_joined(spark, monkeypatch):
    """The same scores whether tokens are in the head or joined."""
    rows = near_rows()
    whole = sorted((tuple(r) for r in lm.score_documents(docs(spark, rows)).collect()), key=str)
    monkeypatch.setattr(lm, "HEAD", 100)
    joined = sorted((tuple(r) for r in lm.score_documents(docs(spark, rows)).collect()), key=str)
    for a, b in zip(whole, joined, strict=True):
        assert a[:5] == b[:5]
        assert a[5] == pytest.approx(b[5])


def test_op2_model_is_normalised_and_learns(spark):
    assert lm.score_documents(docs(spark, [])).count() == 0
    rng = np.random.default_rng(0)
    size = 40
    truth = rng.dirichlet(np.full(size, 0.1), size)
    start = rng.dirichlet(np.full(size, 1.0))
    pairs = rng.poisson(50000 * start[:, None] * truth).astype(np.float32)
    probs = lm.train(pairs, rounds=300, dim=16)
    assert np.allclose((10.0 ** probs.astype(float)).sum(axis=1), 1, atol=1e-4)
    p = pairs / pairs.sum()
    unigram = np.log10(p.sum(axis=0) + 1e-12)
    assert (p * probs).sum() > (p * unigram).sum() + 0.25


def test_op2_beats_base_on_held_out_documents(spark):
    frame = lm.score_documents(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))
    row = frame.where("held_out").agg(F.sum("score"), F.sum("base_score"), F.sum("n_tokens")).first()
    assert row[0] > row[1] + 0.02 * row[2]


# -- operator 6 --------------------------------------------------------------------


def test_op6(spark):
    rows = sorted(ROWS, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    texts = [r[1] or "" for r in rows]
    want = Counter()
    for i, r in enumerate(rows):
        t, follow = texts[i], texts[(i + 1) % len(texts)]
        half = len(t) // 2
        edited = t[: len(t) - half] + follow[:half]
        want[r[0], len(t), hashlib.sha256(edited.encode()).hexdigest()] += 1
    got = fingerprints.digests(fingerprints.edited_fingerprints(docs(spark))).collect()
    assert Counter(tuple(r)[:3] for r in got) == want
    prints = {}
    for r in got:
        text = next(x for x in ROWS if x[0] == r["doc_id"])[1] or ""
        prints.setdefault(text, set()).add(r["fingerprint"])
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
    assert all(len(p) == 1 for p in prints.values()) and len(set().union(*prints.values())) == len(prints)
    assert fingerprints.digests(fingerprints.edited_fingerprints(docs(spark, []))).count() == 0
    alone = fingerprints.digests(fingerprints.edited_fingerprints(docs(spark, [(5, "ab.\ncd", "en", "s")]))).first()
    assert alone["near_next"] == 1.0 and alone["edited_sha256"] == hashlib.sha256(b"ab.ab.").hexdigest()


def test_op6_blocks(spark, monkeypatch):
    """The next document is right across blocks and levels of blocks."""
    monkeypatch.setattr(fingerprints, "BLOCK", 2)
    monkeypatch.setattr(fingerprints, "SUPER", 2)
    ids = random.Random(4).sample(range(-50, 300), 60)
    frame = docs(spark, [(i, f"t{i}", "en", "s") for i in ids])
    got = {r["doc_id"]: r["next_text"] for r in fingerprints.with_next(frame, 5).collect()}
    order = sorted(ids)
    assert got == {a: f"t{b}" for a, b in zip(order, [*order[1:], order[0]], strict=True)}


def test_op6_hot_ids(spark, monkeypatch):
    """A third of the rows without an id, an id many texts share, and one row many times."""
    import xxhash

    monkeypatch.setattr(fingerprints, "BLOCK", 4)
    monkeypatch.setattr(fingerprints, "SUPER", 3)
    rows = [(None, f"no id {i % 60}", "en", "s") for i in range(100)]
    rows += [(7, f"shared id {i}.\nparts", "en", "s") for i in range(70)] + [(8, "the same row. twice", "en", "s")] * 60
    rows += [(i, f"own {i}", "en", "s") for i in range(20, 90)]
    frame = docs(spark, rows)
    blocks = {}
    for r in fingerprints._in_blocks(frame).collect():
        blocks.setdefault(tuple(r["block"]), []).append(r["copies"])
    # 60 and 70 distinct rows in pieces, 60 equal ones as one
    assert max(map(len, blocks.values())) <= 16 and max(max(c) for c in blocks.values()) == 60
    signed = lambda t: (lambda h: h - 2**64 if h >= 2**63 else h)(xxhash.xxh64_intdigest(t.encode(), 42))
    rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, signed(r[1])))
    want = Counter()
    for i, r in enumerate(rows):
        t, follow = r[1], rows[(i + 1) % len(rows)][1]
        half = len(t) // 2
        want[r[0], len(t), hashlib.sha256((t[: len(t) - half] + follow[:half]).encode()).hexdigest()] += 1
    got = fingerprints.digests(fingerprints.edited_fingerprints(frame)).collect()
    assert Counter(tuple(r)[:3] for r in got) == want
    same = [r for r in got if r["doc_id"] == 8]
    assert len(same) == 60 and sum(r["near_next"] == 1 for r in same) == 59


def test_op6_homomorphism(spark):
    parts = [f"paragraph {i % 7} of many" for i in range(30)]
    random.Random(1).shuffle(parts)
    texts = ["\n".join(parts), "\n".join(reversed(parts)), "\n".join(parts[:20]), "\n".join(parts[20:]), "\n".join(parts[5:])]
    rows = fingerprints.fingerprint_texts(docs(spark, [(i, t, "en", "s") for i, t in enumerate(texts)]))
    v = {r["doc_id"]: r["vector"] for r in rows.collect()}
    assert v[0] == v[1] != v[4]
    frame = spark.createDataFrame([(v[0], v[2], v[3], v[4])], "a array<long>, b array<long>, c array<long>, d array<long>")
    row = frame.select(
        (fingerprints.add(F.col("b"), F.col("c")) == F.col("a")).alias("sum"),
        (fingerprints.subtract(F.col("a"), F.col("c")) == F.col("b")).alias("rest"),
        fingerprints.likeness(F.col("a"), F.col("d")).alias("near"),
    ).first()
    assert row["sum"] and row["rest"] and row["near"] > 0.7


# -- operator 10 -------------------------------------------------------------------


def grams(text, k=5):
    w = (text or "").lower().split()
    return {" ".join(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({" ".join(w)} if w else set())


def leak_case():
    rng = random.Random(9)
    vocabulary = [f"v{i}" for i in range(500)]
    some = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    items = [(i, " ".join(some(rng.choice([6, 9, 20, 40, 70]))).title()) for i in range(30)]
    items += [(100, None), (101, ""), (102, "just three words"), (103, items[0][1]), (None, items[1][1])]
    rows = list(ROWS)
    for i, text in items[:25]:
        for edits in range(6):
            w = text.split()
            for _ in range(edits):
                w[rng.randrange(len(w))] = "edited"
            rows.append((2000 + 10 * i + edits, " ".join(some(300) + w + some(rng.randrange(200))), "en", "s"))
    rows.append((3000, "just three words", "en", "s"))
    rows.append((None, items[4][1], "en", "s"))
    return rows, items


def test_op10(spark):
    rows, items = leak_case()
    want = {}
    for d, text, *_ in rows:
        for i, t in items:
            q = grams(t)
            m = len(q & grams(text))
            if q and m >= 0.8 * len(q):
                want[d, i] = max(want.get((d, i), (0,)), (m / len(q), m, len(q)))
    frame = spark.createDataFrame([(*x, 1.0) for x in items], "item_id long, text string, containment double")
    found = decontaminate.contained_items(docs(spark, rows), frame).collect()
    got = {(r["doc_id"], r["item_id"]): (r["containment"], r["matched"], r["item_shingles"]) for r in found}
    assert got == want and len(found) == len(want) and len(want) > 30
    clean = decontaminate.decontaminate(docs(spark, rows), frame)
    leaks = lambda text: any(q and len(q & grams(text)) >= 0.8 * len(q) for q in (grams(t) for _, t in items))
    stay = Counter((r[0], r[1]) for r in rows if not leaks(r[1]))
    assert Counter((r["doc_id"], r["text"]) for r in clean.collect()) == stay
    assert stay[None, "a row without an id"] == 1 and (None, items[4][1]) not in stay
    assert clean.columns == docs(spark).columns


def test_op10_empty(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.contained_items(docs(spark), none).count() == 0
    assert decontaminate.decontaminate(docs(spark), none).count() == len(ROWS)
    one = spark.createDataFrame([(1, "a b c d e f")], "item_id long, text string")
    assert decontaminate.contained_items(docs(spark, []), one).count() == 0
