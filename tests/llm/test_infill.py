"""Operator 12 against plain Python, and exact round trips."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter

from hypothesis import given
from hypothesis import strategies as st

from sparkpul.llm import infill
from tests.llm.fixtures import ROWS, bag, docs

UNIT = re.compile(r"[A-Za-z]+|[^A-Za-z]")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def want_op12(d, text):
    text = text or ""
    units = UNIT.findall(text)
    n = len(units)
    digest = sha(f"1:{'' if d is None else d}")
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return d, n, "plain", None, None, sha(text), sha(text)
    if h[3] % 100 < 20:
        return d, n, "spm", len(p), len(m), sha(f"<S>{s}<P>{p}<M>{m}"), sha(text)
    return d, n, "psm", len(p), len(m), sha(f"<P>{p}<S>{s}<M>{m}"), sha(text)


def cases():
    rng = random.Random(8)
    odd = ["<P>", "a<M>b", "<S", "S>", "<", ">", "P>x<", "\x00", "é" * 40, "\U0001f600" * 9, "word " * 30, "x" * 500]
    for i in range(400):
        yield i, "".join(rng.choice([*odd[2:], "ab", " ", "Zz9", "\n"]) for _ in range(rng.randrange(12))), "en", "a"
    for i, t in enumerate(odd):
        yield 1000 + i, t, "en", "a"


def test_op12(spark):
    rows = [*ROWS, *cases()]
    got = bag(infill.digests(infill.fill_in_middle(docs(spark, rows))))
    assert got == Counter(want_op12(r[0], r[1]) for r in rows)
    forms = Counter(k[2] for k in got.elements())
    assert all(forms[f] for f in ("plain", "psm", "spm"))


@given(st.text(alphabet="abZ<>PSM 9\né\U0001f600", max_size=80), st.integers(1, 9))
def test_sections_give_the_units_of_the_text(text, section):
    assert infill.unit_ends(text, section).tolist() == [m.end() for m in UNIT.finditer(text)]


@given(st.text(alphabet="abZ<>PSM 9\né", max_size=60), st.tuples(*[st.integers(0, 2**32 - 1)] * 4))
def test_round_trip(text, draws):
    n, form, a, m, output = infill.cut(text, draws)
    assert infill.restore(output, form) == text and n == len(UNIT.findall(text))
    assert (a is None) == (m is None) == (form == "plain")


def test_very_long_text():
    """Longer than one match takes, with a single unit over several sections."""
    text = "word, " * 300_000 + "x" * 700_000 + "é\U0001f600" * 200_000
    ends = infill.unit_ends(text)
    assert len(ends) == len(UNIT.findall(text)) and ends[-1] == len(text)
    for draws in ((5, 1 << 31, 0, 0), (7, 1 << 30, 0, 99)):
        _, form, _, _, output = infill.cut(text, draws)
        assert form != "plain" and infill.restore(output, form) == text


def test_other_columns_stay(spark):
    frame = docs(spark).selectExpr("*", "map('k', n_tokens) AS n", "'f' AS form", "1 AS draws", "2 AS output", "3 AS `odd name`")
    out = infill.fill_in_middle(frame, "doc_id")
    assert out.columns == ["row", "n", "form", "prefix_chars", "middle_chars", "output"]
    keep = [c for c in frame.columns if c != "text"]
    as_text = lambda rows: Counter(str(sorted(r.asDict(True).items())) for r in rows)
    kept = frame.select(*[f"`{c}`" for c in keep]).collect()
    assert as_text(r["row"] for r in out.select("row").collect()) == as_text(kept)


def test_empty(spark):
    assert infill.digests(infill.fill_in_middle(docs(spark).limit(0))).collect() == []
