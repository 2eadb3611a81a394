"""Operators 7 and 8 against plain Python over a small fixture."""

from __future__ import annotations

import hashlib
import re
from collections import Counter

import pytest

from sparkpul.llm import secrets, urls
from sparkpul.llm.bloom import BlockedBloom
from sparkpul.llm.queries import URL_RULES
from tests.llm.fixtures import OWN_TOKEN, ROWS, bag, docs

URLS = [
    "http://a.net/x", "http://net/x", "http://net", "http://notnet/x", "HTTP://A.B.Example.NET/en/1?q#f",
    "http://example.net/en", "http://example.net/en/?x", "https://m.example.com/de/z", "https://x.org/fr/#t",
    "https://x.org/Fr/", "no scheme", None, "", "://net/", "a://b://net/", "ftp://u@net:80/p", "http://./..",
    "http://EXAMPLE.com/de/\nline", "x://net/", "x://net/",
]


def judged(url):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host):])[0]
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = [(-len(h + p), h + p, v) for h, p, v in URL_RULES
            if (host == h or host.endswith("." + h)) and path.startswith(p)]
    _, rule, verdict = min(fits, default=(0, None, "allow"))
    return host, path, rule, verdict


def test_op7(spark):
    pages = spark.createDataFrame([(i, u, "h", "r") for i, u in enumerate(URLS)] + [(None, "x://net/", "", "")],
                                  "page_id long, url string, host string, rule string")
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    want = Counter((i, *judged(u)) for i, u in enumerate(URLS)) + Counter([(None, *judged("x://net/"))])
    assert bag(urls.judge_urls(pages, rules)) == want
    assert urls.judge_urls(pages.limit(0), rules).count() == 0
    assert bag(urls.judge_urls(pages, rules.limit(0)).select("verdict")) == Counter({("allow",): len(URLS) + 1})


def test_bloom_loses_nothing_and_filters(spark):
    listed = spark.range(0, 5000).selectExpr("cast(id as string) as k")
    bloom = BlockedBloom(listed, "k")
    other = spark.range(0, 50000).selectExpr("cast(id as string) as k")
    found = bloom.possible(other, "k")
    assert found.where("cast(k as int) < 5000").count() == 5000
    assert found.count() < 5000 + 45000 * 0.05
    full = BlockedBloom(listed, "k", max_blocks=1)  # saturated: everything passes, nothing is lost
    assert full.possible(listed, "k").count() == 5000


def base_spans(text):
    out = []
    assign = re.compile("(?i:password|passwd|secret|token|api_?key)[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
    out += [(m.start(), 0, m.end()) for m in assign.finditer(text) if len(m[1]) >= 6]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(out)


def readable(value):
    return re.match(secrets.UUID, value) or all(re.match(secrets.PLAIN_PART, p) for p in re.split(secrets.SEPARATORS, value))


def all_spans():
    """Brute force: base spans and owner-specific opaque runs of every row."""
    opaque, owners = [], {}
    for _, text, _, source in ROWS:
        text = text or ""
        base = base_spans(text)
        mine = [m for m in re.finditer("[A-Za-z0-9+/_=-]{20,}", text)
                if re.search("[0-9]", m[0]) and re.search("[A-Za-z]", m[0]) and not readable(m[0])
                and not any(a < m.end() and m.start() < b for a, _, b in base)]
        opaque.append(mine)
        for m in mine:
            owners.setdefault(m[0], set()).add(source or "")
    return [sorted(base_spans(r[1] or "") + [(m.start(), 3, m.end()) for m in found if len(owners[m[0]]) <= 2])
            for r, found in zip(ROWS, opaque, strict=True)]


def written(spans):
    return ",".join(f"{secrets.NAMES[k]}:{a}:{b}" for a, k, b in spans)


def test_op8(spark):
    want = Counter()
    for (i, *_), spans in zip(ROWS, all_spans(), strict=True):
        base = [s for s in spans if s[1] < 3]
        counts = [sum(s[1] == k for s in base) for k in range(3)]
        want[(i, *counts, hashlib.sha256(written(base).encode()).hexdigest(), written(spans))] += 1
    got = secrets.digests(secrets.find_secrets(docs(spark))).drop("n_live", "n_example")
    assert bag(got) == want
    assert any("opaque" in k[-1] for k in want)
    assert secrets.digests(secrets.find_secrets(docs(spark, []))).count() == 0


def test_redact(spark):
    want = Counter()
    for (i, text, *_), spans in zip(ROWS, all_spans(), strict=True):
        if text is not None:
            out, at = "", 0
            for a, _, b in spans:
                if a >= at:
                    out += text[at:a] + secrets.MASK
                at = max(at, b)
            text = out + text[at:]
        want[i, text] += 1
    frame = docs(spark)
    got = secrets.redact(frame)
    assert got.columns == frame.columns
    assert bag(got.select("doc_id", "text")) == want
    assert not any(OWN_TOKEN in (t or "") for _, t in want)


@pytest.mark.parametrize("text", ["", "x", "password=abcdef", "token = 'abcde' secret:abcdefg", "AKIA" * 9, "f" * 24 + "g" + "0" * 23])
def test_op8_single(spark, text):
    row = secrets.find_secrets(docs(spark, [(1, text, "en", "s")])).first()
    assert [(s["start"], s["kind"], s["stop"]) for s in row["spans"] if s["kind"] < 3] == base_spans(text)


def test_redact_leaves_readable_runs(spark):
    """URL paths, slugs, file paths and UUIDs stay; opaque credentials go."""
    stay = [
        "see https://example.com/blog/2021-05-how-to-cook now",
        "state-of-the-art-2021-results",
        "id 123e4567-e89b-12d3-a456-426614174000.",
        "/usr/share/doc/python3/Changes_2020",
    ]
    go = [f"key {OWN_TOKEN}", "wJalrXUtnFEMI/K7MDENG/bPxRfiCYEXAMPLEKEY", "sk_live_9f8e7d6c5b4a3a2b1c0d"]
    rows = [(i, t, "en", "a") for i, t in enumerate([*stay, *go])]
    got = {r["doc_id"]: r["text"] for r in secrets.redact(docs(spark, rows)).collect()}
    masked = [f"key {secrets.MASK}", secrets.MASK, secrets.MASK]
    assert [got[i] for i in range(len(rows))] == [*stay, *masked]


def test_copied_widely_by_one_owner(spark):
    """One source holds a value in nine repositories: an example, though it has one owner.
    A value of one owner in three repositories is live; both counts are told."""
    wide, own = "Zq8rT1vW4yX7bN2mK5pL", "Hj3kD9sF6gQ1wE8rT5yU"
    rows = [(i, f"copied {wide} text {i}", f"lang {i % 9}", "hot") for i in range(50)]
    rows += [(100 + i, f"live {own} here", f"lang {i}", "hot") for i in range(3)]
    found = {r["doc_id"]: r["spans"] for r in secrets.find_secrets(docs(spark, rows)).collect()}
    assert all(found[i] == [] for i in range(50))
    for i in range(100, 103):
        (span,) = found[i]
        assert (span["owners"], span["repositories"], span["live"], span["value"]) == (1, 3, True, own)
    text = {r["doc_id"]: r["text"] for r in secrets.redact(docs(spark, rows)).collect()}
    assert all(wide in text[i] for i in range(50)) and all(text[i] == "live [SECRET] here" for i in range(100, 103))
    # with more repositories allowed it is a live value of one owner again
    again = secrets.find_secrets(docs(spark, rows), max_repositories=9).where("doc_id < 50")
    assert all(len(r["spans"]) == 1 and r["spans"][0]["repositories"] == 9 for r in again.collect())


def test_scan_and_redaction_agree(spark):
    """Slugs, paths and UUIDs are spans of neither."""
    stay = ["com/blog/2021-05-how-to-cook", "123e4567-e89b-12d3-a456-426614174000", "/usr/share/doc/python3/Changes_2020"]
    frame = docs(spark, [(i, t, "en", "a") for i, t in enumerate([*stay, OWN_TOKEN])])
    sizes = {r["doc_id"]: len(r["spans"]) for r in secrets.find_secrets(frame).collect()}
    masked = {r["doc_id"]: secrets.MASK in r["text"] for r in secrets.redact(frame).collect()}
    assert sizes == {0: 0, 1: 0, 2: 0, 3: 1} and masked == {0: False, 1: False, 2: False, 3: True}
