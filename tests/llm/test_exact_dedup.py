"""Operator 13 against plain grouping; batches, recovery and the plan of the anti-join."""

from __future__ import annotations

import hashlib
import random
from collections import Counter

import pytest

from sparkpul.llm import exact_dedup
from sparkpul.session import scratch_path
from tests.llm.fixtures import ROWS, docs

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sha(text):
    return hashlib.sha256((text or "").translate(LOWER).encode()).hexdigest()


def fresh(spark, buckets=4):
    return exact_dedup.DigestIndex(spark, scratch_path(spark, "index"), buckets)


def want(rows):
    """Rows as (doc_id, keep_id, group_size, kept, digest): one row of each group is kept."""
    sizes = Counter(sha(r[1]) for r in rows)
    best = {}
    for r in rows:
        best[sha(r[1])] = max(best.get(sha(r[1]), (-1, None)), (0, None) if r[0] is None else (1, r[0]), key=lambda x: (x[0], x[1] or 0))
    out, seen = Counter(), set()
    for r in rows:
        h = sha(r[1])
        kept = r[0] == best[h][1] and h not in seen
        if kept:
            seen.add(h)
        out[r[0], best[h][1], sizes[h], kept, h] += 1
    return out


def got(decided):
    return Counter((r["doc_id"], r["keep_id"], r["group_size"], r["kept"], r["text_sha256"]) for r in exact_dedup.digests(decided).collect())


def hot_rows():
    """A third of all rows are copies, in other case; ids repeat and are missing."""
    rng = random.Random(3)
    for i in range(6000):
        text = rng.choice(["One TEXT", "one text", "ONE text"]) if i % 3 == 0 else f"own {rng.randrange(2500)} É"
        yield rng.choice([i, i, i, i, None, 17]), text, "en", "a"


@pytest.mark.parametrize("batches", [1, 2, 5])
def test_op13(spark, batches):
    rows = [*ROWS, (20, "SAME text HERE", "en", "a"), (21, "É", "en", "a"), (22, "é", "en", "a"), *hot_rows()]
    index = fresh(spark)
    exact_dedup.load(index, docs(spark, rows), batches=batches)
    assert got(index.decisions()) == want(rows)
    assert index.known().count() == len({sha(r[1]) for r in rows})


def test_later_batches(spark):
    """What the index holds stays, in another session's view of it too."""
    index = fresh(spark)
    index.ingest(docs(spark, [(1, "a", "en", "s"), (2, "A", "en", "s"), (3, "b", "en", "s")]), "monday")
    again = exact_dedup.DigestIndex(spark, index.path)
    assert again.buckets == 4
    again.ingest(docs(spark, [(9, "B", "en", "s"), (8, "c", "en", "s"), (7, "c", "en", "s")]), "tuesday")
    now = {(r["doc_id"], r["keep_id"], r["group_size"], r["kept"]) for r in exact_dedup.digests(again.decisions()).collect()}
    assert now == {(1, 2, 2, False), (2, 2, 2, True), (3, 3, 2, True), (9, 3, 2, False), (8, 8, 2, True), (7, 8, 2, False)}


def test_a_batch_taken_in_twice(spark):
    """A batch cut short behind its log or its append is taken up again without doubling."""
    rows = docs(spark, list(hot_rows())[:200])
    index = fresh(spark)
    index._logged(rows, "b", "doc_id", "text")  # the driver died here
    index.ingest(rows, "b")
    once = got(index.decisions())
    index.ingest(rows, "b")  # and here
    assert got(index.decisions()) == once == want(list(hot_rows())[:200])


def test_keep_new(spark):
    """Whole rows come back, with map columns and any names."""
    index = fresh(spark)
    index.ingest(docs(spark, [(1, "a", "en", "s")]), "0")
    frame = docs(spark, [(1, "A", "en", "s"), (2, "b", "en", "s"), (5, "B", "de", "s"), (None, "c", "en", "s"), (None, "c", "en", "s")])
    frame = frame.selectExpr("*", "map('a', 1) AS digest", "1 AS rank", "2 AS whole", "3 AS keep_id")
    kept = exact_dedup.keep_new(index, frame)
    assert kept.columns == frame.columns
    assert sorted((r["doc_id"] or 0, r["text"], r["lang"], r["digest"]["a"]) for r in kept.collect()) == [(0, "c", "en", 1), (5, "B", "de", 1)]


def test_empty(spark):
    index = fresh(spark)
    assert index.decisions().collect() == []
    exact_dedup.load(index, docs(spark).limit(0))
    assert index.decisions().collect() == [] and index.known().count() == 0


def test_the_index_is_not_shuffled(spark):
    """Sort-merge anti-join; the only exchanges are those of the new rows."""
    index = fresh(spark)
    index.ingest(docs(spark), "0")
    rows = index._logged(docs(spark), "1", "doc_id", "text")
    plan = index.fresh(rows.select("digest").distinct())._jdf.queryExecution().executedPlan().toString()
    join = plan[plan.index("SortMergeJoin"):]
    assert "LeftAnti" in join.splitlines()[0]
    right = join[join.index("digest_index_"):] if "digest_index_" in join else join
    assert "Bucketed: true" in right and "Exchange" not in right
