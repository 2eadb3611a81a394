"""Operator 11 against a plain tree over a small fixture."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import Counter

import pytest

from sparkpul.llm import merkle, queries
from tests.llm.fixtures import ROWS, bag, docs


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_leaf(*values):
    return H(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in values])


def plain_tree(nodes, fanout):
    out = [list(nodes)]
    while len(out[-1]) > 1:
        out.append([H(*out[-1][i : i + fanout]) for i in range(0, len(out[-1]), fanout)])
    return out


def plain_proof(tree, i, fanout):
    out = []
    for nodes in tree[:-1]:
        run = range(i - i % fanout, min(i - i % fanout + fanout, len(nodes)))
        out.append(("".join(nodes[j] for j in run if j < i), "".join(nodes[j] for j in run if j > i)))
        i //= fanout
    return out


def first(v):
    return (v is not None, v if v is not None else 0)


def text_first(v):
    return (v is not None, (v or "").encode())


def expected(rows, fanout=2):
    """``doc_id, leaf, subroot, root, proof`` of rows (doc_id, text, lang, source, n_chars)."""
    groups = {}
    for d, text, lang, source, n in rows:
        groups.setdefault(lang, []).append((first(d), plain_leaf(d, source, lang, n, text), d, (d, source, lang, n, text)))
    langs = sorted(groups, key=text_first)
    trees = {lang: plain_tree([x[1] for x in sorted(groups[lang], key=lambda x: x[:2])], fanout) for lang in langs}
    top = plain_tree([trees[lang][-1][0] for lang in langs], fanout)
    for g, lang in enumerate(langs):
        for i, (_, leaf, d, values) in enumerate(sorted(groups[lang], key=lambda x: x[:2])):
            proof = plain_proof(trees[lang], i, fanout) + plain_proof(top, g, fanout)
            yield d, leaf, trees[lang][-1][0], top[-1][0], proof, values


def want_op11(rows):
    for d, leaf, subroot, root, proof, (_, source, lang, n, text) in expected(rows):
        changed = d is not None and zlib.crc32(str(d).encode()) % 7 == 0
        node = plain_leaf(d, source, lang, n if n is None else n + 1, text) if changed else leaf
        for left, right in proof:
            node = H(left, node, right)
        yield d, leaf, subroot, root, H(*[a + b for a, b in proof]), node, node == root


def big_rows(n=300):
    rng = random.Random(5)
    langs = ["en"] * 6 + ["de", "fr", None, "É", "z"]
    return [(rng.choice([i, i, i, None, 7]), f"text {i % 40}\n", rng.choice(langs), rng.choice(["a", None, ""])) for i in range(n)]


@pytest.mark.parametrize("block", [4096, 8])
def test_op11(spark, monkeypatch, block):
    """Odd rows, with trees of one block and of many (four rounds of exchange)."""
    monkeypatch.setattr(merkle, "BLOCK", block)
    rows = [*ROWS, *big_rows()]
    got = bag(merkle.digests(merkle.document_manifest(docs(spark, rows))))
    assert got == Counter(want_op11([(*r, len(r[1] or "")) for r in rows]))


def test_tampering_is_found(spark):
    rows = big_rows(400)
    broken = [r for r in merkle.digests(merkle.document_manifest(docs(spark, rows))).collect() if not r["verified"]]
    assert broken and all(zlib.crc32(str(r["doc_id"]).encode()) % 7 == 0 for r in broken)
    null_counts = docs(spark, rows).selectExpr("doc_id", "text", "lang", "source", "CAST(NULL AS BIGINT) AS n_chars")
    assert all(r["verified"] for r in merkle.digests(merkle.document_manifest(null_counts)).collect())


@pytest.mark.parametrize("fanout", [2, 3, 5])
def test_any_fanout(spark, monkeypatch, fanout):
    """Numbers of leaves around the powers of the fanout, blocks of one level."""
    monkeypatch.setattr(merkle, "BLOCK", fanout)
    sizes = [1, 2, fanout, fanout + 1, fanout**2, fanout**2 + 1, fanout**3 - 1, fanout**3 + 1]
    rows = [(i, f"t{i}", f"g{s}", "a") for s in sizes for i in range(s)]
    proved = merkle.manifest(docs(spark, rows), merkle.LEAF, "lang", ["doc_id"], fanout=fanout)
    got = {
        (r["row"]["doc_id"], r["leaf"], r["subroot"], r["root"], tuple((x["left"], x["right"]) for x in r["path"]))
        for r in proved.collect()
    }
    want = [(*x[:4], tuple(x[4])) for x in expected([(*r, len(r[1])) for r in rows], fanout)]
    assert got == set(want) and len(got) == len(want)


def test_many_groups(spark):
    """More groups than a block has leaves: the tree over the subroots has blocks too."""
    rows = [(i, None, f"lang {i % 97}", None) for i in range(200)]
    old, merkle.BLOCK = merkle.BLOCK, 4
    try:
        got = bag(merkle.digests(merkle.document_manifest(docs(spark, rows))))
    finally:
        merkle.BLOCK = old
    assert got == Counter(want_op11([(*r, 0) for r in rows]))


def test_empty(spark):
    assert merkle.digests(merkle.document_manifest(docs(spark).limit(0))).collect() == []
    with pytest.raises(ValueError):
        merkle.manifest(docs(spark), merkle.LEAF, "lang", ["doc_id"], fanout=1)


def test_extra_columns_play_no_part(spark):
    frame = docs(spark)
    names = ["leaf", "row", "grp", "key", "uid", "pos", "total", "path", "block", "part", "node"]
    more = frame.selectExpr("*", *[f"map('a', 1) AS {n}" for n in names])
    assert bag(merkle.digests(merkle.document_manifest(more))) == bag(merkle.digests(merkle.document_manifest(frame)))


def test_query_is_registered():
    assert "op11_merkle" in queries.queries() and "op11_merkle" in queries.oracle_sql()
