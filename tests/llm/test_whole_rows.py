"""Decisions per row where ids are null or repeated."""

from __future__ import annotations

import random

import pytest

from sparkpul.llm import decontaminate, quality, secrets, simhash
from tests.llm.fixtures import docs


def prose(seed, n=60):
    rng = random.Random(seed)
    return " ".join(f"w{rng.randrange(4000)}" for _ in range(n))


def left(df):
    return sorted(((r["doc_id"], r["text"]) for r in df.collect()), key=str)


def test_decontaminate_by_row(spark):
    """Clean texts stay beside a leaked one, under a null id and under a repeated id."""
    item = prose(1, 20)
    items = spark.createDataFrame([(1, item)], "item_id long, text string")
    leaked = f"before {item} behind"
    clean = [prose(2), prose(3), prose(4)]
    rows = [(None, leaked), (None, clean[0]), (7, leaked), (7, clean[1]), (8, clean[2]), (9, leaked)]
    frame = docs(spark, [(i, t, "en", "s") for i, t in rows])
    want = sorted([(None, clean[0]), (7, clean[1]), (8, clean[2])], key=str)
    assert left(decontaminate.decontaminate(frame, items)) == want


def test_drop_near_duplicates_by_row(spark):
    """Every component keeps one document, whatever other components hold its ids."""
    x, y, z, copied, own = (prose(i) for i in range(10, 15))
    rows = [
        (5, x), (9, x),  # 5 stays here, though another text of id 5 goes below
        (1, y), (5, y),
        (5, z), (20, z),  # a second component whose least id is 5
        (20, own),  # a clean text whose id has a copy
        (None, copied), (None, copied), (None, copied.upper()),
        (None, z),
        (30, "two rows of one document"), (30, "two rows of one document"),
    ]
    frame = docs(spark, [(i, t, "en", "s") for i, t in rows])
    got = left(simhash.drop_near_duplicates(frame))
    unnamed = [t for i, t in got if i is None]
    assert len(unnamed) == 1 and unnamed[0].lower() == copied
    assert [r for r in got if r[0] is not None] == sorted(
        [(5, x), (1, y), (5, z), (20, own), (30, "two rows of one document"), (30, "two rows of one document")], key=str
    )


CLASHING = """row id hash maybe pair spans quality lost_id lost_hash lost_pair leaked leaked_id found_id found_hash fp least
__hash __own __maybe __id __spans __dropped __pair __flagged __quality __bloom_block __bloom_0 QUALITY_""".split()


@pytest.mark.parametrize("stage", ["quality", "simhash", "decontamination", "secrets"])
def test_columns_stay_as_they_are(spark, stage):
    """Extra columns with any name, one of them a map, come through every stage unchanged."""
    texts = [(i % 9 or None, prose(i), "en", "s") for i in range(40)]
    texts += [(3, "password=hunter2secret", "en", "s"), (None, prose(1), "en", "s"), (None, prose(1), "en", "s")]
    base = docs(spark, texts).drop("spans")
    frame = base.selectExpr("*", *[f"concat('{c}', n_chars) AS {c}" for c in CLASHING], "map('k', doc_id) AS `a map`")
    if stage == "quality":
        labels = spark.createDataFrame([(i, i % 2) for i in range(1, 9)], "doc_id long, quality int")
        out = quality.keep_good(frame, labels, 0.0)
    elif stage == "simhash":
        out = simhash.drop_near_duplicates(frame)
    elif stage == "decontamination":
        out = decontaminate.decontaminate(frame, spark.createDataFrame([(1, prose(2))], "item_id long, text string"))
    else:
        out = secrets.redact(frame)
    assert out.columns == frame.columns
    rows = out.collect()
    assert 0 < len(rows) <= len(texts) and {r["doc_id"] for r in rows} >= {None, 3}
    for r in rows:
        assert all(r[c] == f"{c}{r['n_chars']}" for c in CLASHING) and r["a map"] == {"k": r["doc_id"]}
    assert all(r["text"] in {t[1] for t in texts} or "[SECRET]" in r["text"] for r in rows)
