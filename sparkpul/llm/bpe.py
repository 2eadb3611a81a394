"""Byte-level BPE encoding and decoding with a segment tree per piece (operator 4).

A text is cut into pieces by the pattern of the rank file; each piece is encoded on its
own. Over the byte positions of a piece stands a segment tree whose leaves hold the rank
of the pair that starts there (the live part at that position and its right neighbour)
and whose inner nodes hold the minimum of their subtree. The root gives the lowest rank,
a walk down that prefers the left child gives its leftmost position. A merge changes
three leaves (the merged part, its left neighbour and the part that vanished), each a
point update of ``log2(n)`` nodes, so a piece of n bytes costs ``O(n log n)`` whatever it
holds.

Many pieces are short, and new ones are encoded together: the trees of all pieces of one
size class are the rows of a numpy array and advance in lockstep, one merge per round.
Long pieces walk their own tree.

Defined results: null text counts as empty and gives no ids; decoding gives the text's
UTF-8 bytes back exactly. Extra columns are ignored, repeated rows give repeated results,
an empty table an empty one.
"""

from __future__ import annotations

import base64
import re
from array import array
from itertools import chain

import numpy as np
import pyarrow as pa
import public_tokenizers
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkpul.llm.common import map_slices, remembers

RANK_FILE = "byte_bpe_50k.tiktoken"
#: no pair here
NONE = np.int32(2**31 - 1)
#: the longest piece that is encoded in lockstep with others
LOCKSTEP_BYTES = 64
#: chunks remembered by one Python worker
CACHE_CHUNKS = 3 << 17
CHUNK = re.compile(r"[ \n]*[^ \n]+|[ \n]+")
OTHER_SPACE = re.compile(r"[^\S \n]")

EMPTY = np.zeros(0, np.int32)
ENCODED_SCHEMA = "doc_id long, token_ids array<int>, decoded binary"


class RankedPairs:
    """A rank file: token bytes by id, ids by bytes, and the rank of every mergeable pair."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.tokens: list[bytes] = [b""] * (max(self.ranks.values()) + 1)
        for token, rank in self.ranks.items():
            self.tokens[rank] = token
        self.width = len(self.tokens)
        self.byte_ids = np.array([self.ranks[bytes([b])] for b in range(256)], np.int32)
        pairs = {}
        for token, rank in self.ranks.items():
            for cut in range(1, len(token)):
                left, right = self.ranks.get(token[:cut]), self.ranks.get(token[cut:])
                if left is not None and right is not None:
                    pairs[left * self.width + right] = rank
        self.pairs = pairs
        self.keys = np.array(sorted(pairs), np.int64)
        self.values = np.array([pairs[k] for k in self.keys.tolist()], np.int32)

    def pair_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair of ids, ``NONE`` where the pair does not merge."""
        want = np.where((left < 0) | (right < 0), -1, left.astype(np.int64) * self.width + right)
        at = np.minimum(np.searchsorted(self.keys, want), len(self.keys) - 1)
        return np.where(self.keys[at] == want, self.values[at], NONE)


def encode_piece(piece: bytes, table: RankedPairs) -> list[int]:
    """Encode one piece with its own segment tree."""
    if piece in table.ranks:
        return [table.ranks[piece]]
    n = len(piece)
    none, pairs, width = int(NONE), table.pairs, table.width
    part = table.byte_ids[np.frombuffer(piece, np.uint8)].tolist()
    leaves = 1 << max(1, (n - 1).bit_length())
    tree = [none] * (2 * leaves)
    for i in range(n - 1):
        tree[leaves + i] = pairs.get(part[i] * width + part[i + 1], none)
    for node in range(leaves - 1, 0, -1):
        tree[node] = min(tree[2 * node], tree[2 * node + 1])
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))

    def put(i: int, rank: int) -> None:
        node = leaves + i
        tree[node] = rank
        node >>= 1
        while node:
            low = min(tree[2 * node], tree[2 * node + 1])
            if tree[node] == low:
                return
            tree[node] = low
            node >>= 1

    while tree[1] != none:
        low, node = tree[1], 1
        while node < leaves:
            node = 2 * node if tree[2 * node] == low else 2 * node + 1
        i = node - leaves
        gone = after[i]
        part[i] = low
        after[i] = after[gone]
        if after[i] < n:
            before[after[i]] = i
        part[gone] = -1
        put(gone, none)
        put(i, pairs.get(low * width + part[after[i]], none) if after[i] < n else none)
        if before[i] >= 0:
            put(before[i], pairs.get(part[before[i]] * width + low, none))
    return [x for x in part if x >= 0]


def encode_lockstep(pieces: list[bytes], table: RankedPairs, leaves: int) -> list[list[int]]:
    """Encode pieces of at most ``leaves`` bytes, one tree per row, one merge per round.

    The rows lie one after the other in flat arrays; a round picks the leftmost lowest
    pair of every unfinished row and updates its three leaves in one climb.
    """
    m, depth = len(pieces), leaves.bit_length() - 1
    length = np.array([len(p) for p in pieces])
    flat = np.frombuffer(b"".join(p.ljust(leaves, b"\0") for p in pieces), np.uint8).reshape(m, leaves)
    place = np.arange(leaves)
    # two columns more: a pair with a position outside the piece is with part -1
    part = np.full((m, leaves + 2), -1, np.int32)
    part[:, :leaves] = np.where(place < length[:, None], table.byte_ids[flat], -1)
    after = np.minimum(np.arange(leaves + 2) + 1, length[:, None])
    before = np.tile(np.where(np.arange(leaves + 2) == 0, leaves + 1, np.arange(leaves + 2) - 1), (m, 1))
    tree = np.full((m, 2 * leaves), NONE, np.int32)
    tree[:, leaves:] = table.pair_ranks(part[:, :leaves], part[:, 1 : leaves + 1])
    level = leaves // 2
    while level:
        tree[:, level : 2 * level] = np.minimum(tree[:, 2 * level : 4 * level : 2], tree[:, 2 * level + 1 : 4 * level : 2])
        level //= 2
    part, after, before, tree = part.ravel(), after.ravel(), before.ravel(), tree.ravel()
    rows = np.flatnonzero(tree[1 :: 2 * leaves] != NONE)
    while len(rows):
        base, own = rows * (2 * leaves), rows * (leaves + 2)
        low = tree[base + 1]
        node = np.ones(len(rows), np.int64)
        for _ in range(depth):
            node += node
            node += tree[base + node] != low
        at = node - leaves
        gone = after[own + at]
        follow = after[own + gone]
        back = before[own + at]
        part[own + at] = low
        part[own + gone] = -1
        after[own + at] = follow
        before[own + follow] = at
        before_is = back < leaves
        back_leaf = np.where(before_is, back, gone)
        ranks = table.pair_ranks(
            np.concatenate([low, part[own + back]]), np.concatenate([part[own + follow], low])
        )
        k = len(rows)
        node = np.concatenate([base + leaves + gone, base + leaves + at, base + leaves + back_leaf])
        tree[node[:k]] = NONE
        tree[node[k : 2 * k]] = ranks[:k]
        tree[node[2 * k :][before_is]] = ranks[k:][before_is]
        top = np.concatenate([base, base, base])
        node -= top
        for _ in range(depth):
            node >>= 1
            child = top + 2 * node
            tree[top + node] = np.minimum(tree[child], tree[child + 1])
        rows = rows[tree[base + 1] != NONE]
    live = part.reshape(m, leaves + 2) >= 0
    ids, ends = part[live.ravel()].tolist(), np.cumsum(live.sum(axis=1)).tolist()
    return [ids[a:b] for a, b in zip([0, *ends], ends, strict=False)]


def encode_pieces(pieces: list[bytes], table: RankedPairs) -> list[list[int]]:
    """Encode many pieces: short ones in lockstep by size class, long ones one by one."""
    out: list = [None] * len(pieces)
    classes: dict[int, list[int]] = {}
    for i, piece in enumerate(pieces):
        rank = table.ranks.get(piece)
        if rank is not None:
            out[i] = [rank]
        elif len(piece) > LOCKSTEP_BYTES:
            out[i] = encode_piece(piece, table)
        else:
            classes.setdefault(1 << max(1, (len(piece) - 1).bit_length()), []).append(i)
    for leaves, members in classes.items():
        for i, ids in zip(members, encode_lockstep([pieces[i] for i in members], table, leaves), strict=True):
            out[i] = ids
    return out


class Encoder:
    """Encodes texts; remembers the ids of up to ``CACHE_CHUNKS`` chunks.

    A chunk is a run of spaces and line feeds with the run of other characters after it.
    No piece of the pattern goes on from a character that is no white space to one that
    is, so chunks can be cut into pieces alone. A text with other white space is not
    chunked.
    """

    def __init__(self, path: str, pattern: str):
        self.table = RankedPairs(path)
        self.find = regex.compile(pattern).findall
        self.known: dict[str, bytes] = {}

    def encode_all(self, texts: list[str]) -> list[np.ndarray]:
        cut = [[t] if OTHER_SPACE.search(t) else CHUNK.findall(t) for t in texts]
        if len(self.known) > CACHE_CHUNKS:
            self.known.clear()
        new = list(set(chain.from_iterable(cut)).difference(self.known))
        pieces = list(map(self.find, new))
        distinct = list(set(chain.from_iterable(pieces)))
        ids = dict(zip(distinct, encode_pieces([p.encode() for p in distinct], self.table), strict=True))
        for chunk, parts in zip(new, pieces, strict=True):
            self.known[chunk] = array("i", chain.from_iterable(map(ids.__getitem__, parts))).tobytes()
        get = self.known.__getitem__
        out = [np.frombuffer(b"".join(map(get, chunks)), np.int32) for chunks in cut]
        for chunk in new:
            if len(chunk) > LOCKSTEP_BYTES:  # unlikely to come again
                del self.known[chunk]
        return out

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.table.tokens.__getitem__, ids.tolist()))


_ENCODERS: dict[tuple[str, str], Encoder] = {}
remembers(__name__, _ENCODERS.clear)


def encoder(path: str, pattern: str) -> Encoder:
    """The encoder of this Python worker for a rank file."""
    if (path, pattern) not in _ENCODERS:
        _ENCODERS[path, pattern] = Encoder(path, pattern)
    return _ENCODERS[path, pattern]


def encode_documents(
    docs: DataFrame, rank_path: str | None = None, pattern: str = public_tokenizers.PATTERN
) -> DataFrame:
    """``doc_id, token_ids, decoded``: the ids of every whole text and the bytes they decode to.

    ``rank_path`` names a tiktoken rank file that every executor can read. One pass in
    the tasks that read the texts, no shuffle.
    """
    path = rank_path or public_tokenizers.path(RANK_FILE)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        own = encoder(path, pattern)
        ids = own.encode_all([t or "" for t in batch.column(1).to_pylist()])
        offsets = np.cumsum([0, *map(len, ids)]).astype(np.int32)
        return pa.RecordBatch.from_arrays(
            [
                batch.column(0),
                pa.ListArray.from_arrays(offsets, pa.array(np.concatenate([*ids, EMPTY]))),
                pa.array([own.decode(x) for x in ids], pa.binary()),
            ],
            ["doc_id", "token_ids", "decoded"],
        )

    return map_slices(docs.select(F.col("doc_id").cast("long"), "text"), run, ENCODED_SCHEMA, budget=1 << 20)


def digests(encoded: DataFrame) -> DataFrame:
    """The contract columns of operator 4 from its output."""
    return encoded.select(
        "doc_id",
        F.size("token_ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(" ", F.col("token_ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
