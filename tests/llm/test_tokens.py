"""Operators 4 and 9 against the libraries themselves."""

from __future__ import annotations

import hashlib
import zlib
from collections import Counter

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from sparkpul.llm import bpe, huffman
from sparkpul.session import scratch_path
from tests.llm.fixtures import ROWS, bag, docs


@pytest.fixture(scope="module")
def own():
    return bpe.encoder(P.path(bpe.RANK_FILE), P.PATTERN)


@pytest.fixture(scope="module")
def library(own):
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=own.table.ranks, special_tokens={})


def sha(data) -> str:
    return hashlib.sha256(data if isinstance(data, bytes) else data.encode()).hexdigest()


def test_op4_equals_library(spark, library):
    want = Counter()
    for i, text, *_ in ROWS:
        ids = library.encode_ordinary(text or "")
        want[i, len(ids), sha(" ".join(map(str, ids))), sha(text or "")] += 1
    assert bag(bpe.digests(bpe.encode_documents(docs(spark)))) == want


def test_op4_empty_table(spark):
    assert bpe.digests(bpe.encode_documents(docs(spark, []))).count() == 0


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab \n\t'stdé世\u00a0\x1c1.,\U0001f600", max_size=90))
def test_op4_any_text(own, library, text):
    assert own.encode_all([text])[0].tolist() == library.encode_ordinary(text)
    assert own.decode(own.encode_all([text])[0]) == text.encode()


def test_op4_both_tree_forms_agree(own, library):
    rng = np.random.default_rng(3)
    for size in (1, 2, 3, 5, 17, 33, 64):
        pieces = [bytes(rng.choice(list(b"abetionsh"), size)) for _ in range(50)]
        pieces = [p for p in pieces if p not in own.table.ranks]
        alone = [bpe.encode_piece(p, own.table) for p in pieces]
        assert bpe.encode_pieces(pieces, own.table) == alone
        assert alone == [library._encode_single_piece(p) for p in pieces]


def want_op9():
    t = Tokenizer.from_file(P.path(huffman.TOKENIZER_FILE))
    ids = [(r[0], [*t.encode(r[1] or "", add_special_tokens=False).ids, huffman.END_ID]) for r in ROWS]
    ids.sort(key=lambda x: (x[0] is not None, x[0] or 0, len(x[1])))
    want, start = Counter(), 0
    for i, x in ids:
        want[i, start, len(x), zlib.crc32(np.array(x, "<u4").tobytes())] += 1
        start += len(x)
    return want


@pytest.mark.parametrize("files", [1, 3, 8])
def test_op9_round_trip(spark, files):
    path = scratch_path(spark, "t-op9")
    huffman.write_token_files(docs(spark), path, files=files)
    assert bag(huffman.digests(huffman.read_token_files(spark, path))) == want_op9()


def test_op9_small_containers(spark, monkeypatch):
    path = scratch_path(spark, "t-op9")
    monkeypatch.setattr(huffman, "CONTAINER_IDS", 10)
    huffman.write_token_files(docs(spark), path, files=2)
    assert bag(huffman.digests(huffman.read_token_files(spark, path))) == want_op9()


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="abAZ \n.,'!*_-9éÉ\u0130\u0307\u0958σΣ²\u00a0\t", max_size=60))
def test_op9_words_equal_library(text):
    """Texts cut into remembered parts have the ids of the whole text."""
    words = huffman.words_of(P.path(huffman.TOKENIZER_FILE))
    want = words.tokenizer.encode(text, add_special_tokens=False).ids
    assert words.encode_all([text], 2)[0].tolist() == [*want, 2]


def test_op9_empty_table(spark):
    path = scratch_path(spark, "t-op9")
    huffman.write_token_files(docs(spark, []), path)
    assert huffman.read_token_files(spark, path).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 10**6), min_size=1, max_size=300), st.integers(9, 18))
def test_code_lengths_are_a_code(counts, limit):
    lengths = huffman.code_lengths(np.array(counts), limit)
    used = lengths[lengths > 0]
    assert len(used) == np.count_nonzero(counts) and (used <= limit).all()
    assert (2.0**-used).sum() <= 1
    code = huffman.Code(lengths) if len(used) else None
    if code:
        ids = np.repeat(np.flatnonzero(lengths), 3).astype(np.uint32)
        (payload, at), = code.encode([ids])
        at = np.frombuffer(at, np.int64)
        size = np.minimum(huffman.BLOCK_IDS, len(ids) - huffman.BLOCK_IDS * np.arange(len(at)))
        assert (code.decode(payload, at, size) == ids).all()


def test_code_lengths_match_plain_huffman():
    import heapq

    rng = np.random.default_rng(1)
    counts = rng.integers(1, 1000, 200)
    heap = [(int(c), i, (i,)) for i, c in enumerate(counts)]
    heapq.heapify(heap)
    cost, n = 0, 1000
    while len(heap) > 1:
        a, b = heapq.heappop(heap), heapq.heappop(heap)
        cost += a[0] + b[0]
        heapq.heappush(heap, (a[0] + b[0], n, ()))
        n += 1
    assert (huffman.code_lengths(counts, 18) * counts).sum() == cost


ADDED = ["<|endoftext|>", "<|startoftext|>", "<|EndOfText|>", "<|end\noftext|>", "<|ENDOFTEXT|>."]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from([*ADDED, "end of page", "Next", " ", "\n", ". ", "é", "<|", "|>", "7"]), max_size=8).map("".join))
def test_op9_added_tokens_equal_library(text):
    """Added tokens have their own ids, as the library gives them without any flag."""
    plain = Tokenizer.from_file(P.path(huffman.TOKENIZER_FILE))
    words = huffman.words_of(P.path(huffman.TOKENIZER_FILE))
    assert words.encode_all([text], 2)[0].tolist() == [*plain.encode(text, add_special_tokens=False).ids, 2]


def test_op9_added_tokens_in_files(spark):
    plain = Tokenizer.from_file(P.path(huffman.TOKENIZER_FILE))
    texts = ["end of page <|endoftext|> next", "<|startoftext|>", "x <|EndOfText|> y", "plain", None]
    path = scratch_path(spark, "t-op9")
    huffman.write_token_files(docs(spark, [(i, t, "en", "a") for i, t in enumerate(texts)]), path, files=2)
    got = {r["doc_id"]: r for r in huffman.read_token_files(spark, path).collect()}
    start = 0
    for i, text in enumerate(texts):
        ids = [*plain.encode(text or "", add_special_tokens=False).ids, huffman.END_ID]
        assert np.frombuffer(got[i]["token_ids"], "<u4").tolist() == ids and got[i]["start"] == start
        start += len(ids)
