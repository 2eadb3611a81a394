"""Token ids of a corpus in files of canonical length-limited Huffman codes (operator 9).

The texts are tokenized once, into a table of ids in the shared scratch folder. Every id
of the whole corpus is counted; from the counts come code lengths (package-merge, at most
``limit`` bits), and from the lengths alone the canonical codes. A second pass over the
ids encodes each document and deals it by
``doc_id`` range to files, inside a file in ascending ``doc_id`` order. A file is a
Parquet part whose rows are containers of about ``CONTAINER_IDS`` ids of whole documents:
their ``doc_id`` and number of ids, one bit stream per document (each from a full byte
on), and the bit offset of every ``BLOCK_IDS``-th id of a document. These checkpoints cut
the stream into blocks that decode independently of each other: the reader advances all
blocks of a container together, one id per block and round, each by one look-up in a
table of ``2**limit`` entries.

Only the code lengths (one per vocabulary entry) and one count per file ever reach the
driver.

Defined results: null text is an empty document, which holds just the end id; rows with
equal ``doc_id`` keep their own entries, in an order fixed by length and content; null
``doc_id`` comes first; an empty table gives no files and reads back empty. Extra columns
are ignored.
"""

from __future__ import annotations

import os
import re
from array import array

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkpul.llm.common import in_slices, map_slices, materialize

TOKENIZER_FILE = "word_bpe_49k.json"
END_ID = 2
BLOCK_IDS = 256
CONTAINER_IDS = 1 << 20
#: most bits of a code; raised where a vocabulary needs more
LIMIT = 18
CACHE_WORDS = 1 << 20
# letters that lower-casing and normalisation leave one letter (others may end in a mark,
# which would go with the signs behind it)
LETTER = "a-zA-ZÀ-ÖØ-öø-ÿ"
#: a full stop or comma that may belong to a run of signs or marks
STOP_AFTER_SIGN = re.compile(rf"[.,] (?<![{LETTER}0-9 ][.,] )")
#: letters followed by signs, an apostrophe not among them: the tokenizer cuts between
LETTERS_SIGNS = re.compile(rf"([^\W\d_]*[{LETTER}])([!-&(-/:-@\[-`{{-~]+)").fullmatch

CODED = "pid int, doc_id long, n_tokens long, payload binary, checkpoints binary"
CONTAINER = (
    "file_no int, seq int, start_in_file long, doc_ids array<long>, n_tokens array<long>, "
    "doc_bytes array<long>, payload binary, checkpoints binary"
)
READ = "doc_id long, start long, n_tokens long, token_ids binary"


# -- tokens ------------------------------------------------------------------------


class Words:
    """Ids of texts by a tokenizer whose rules never look across a space or line feed.

    The tokenizer drops white space and cuts at it, and it cuts between letters and the
    signs behind them. So the parts between are encoded by the library, and the words met
    first (the frequent ones) are remembered, up to ``CACHE_WORDS``. Texts that hold an added
    token go to the library whole: it finds those in the text as it is, before any rule.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.known: dict[str, bytes] = {}

    @staticmethod
    def spaced(text: str) -> str:
        """``text`` with a space wherever it may be cut."""
        # the tokenizer lower-cases; doing so for A-Z before makes fewer words
        text = text.encode().lower().decode().replace("\n", " ")
        if not STOP_AFTER_SIGN.search(text):
            text = text.replace(". ", " . ").replace(", ", " , ")
        return text

    def learn(self, words: list[str]) -> None:
        """Put the ids of all ``words`` among the known."""
        new = set(words).difference(self.known)
        # letters with signs behind them are two parts, and both may be known
        pairs = {w: m.groups() for w, m in zip(new, map(LETTERS_SIGNS, new), strict=True) if m}
        parts = list(new.difference(pairs).union(*pairs.values()).difference(self.known))
        # lower-casing can make an added token of a part where the text has none
        self.tokenizer.encode_special_tokens = True
        found = self.tokenizer.encode_batch_fast(parts, add_special_tokens=False)
        self.tokenizer.encode_special_tokens = False
        known = self.known
        known.update((w, array("I", x.ids).tobytes()) for w, x in zip(parts, found, strict=True))
        known.update([(w, known[head] + known[tail]) for w, (head, tail) in pairs.items()])

    def encode_all(self, texts: list[str], end_id: int) -> list[np.ndarray]:
        whole = [i for i, t in enumerate(texts) if any(a in t for a in self.added)]
        cut = list(map(self.spaced, texts))
        for i in whole:
            cut[i] = ""
        # Arrow cuts and numbers the words, so Python meets each word of a slice once
        parts = pc.split_pattern(pa.array(cut, pa.large_string()), " ")
        coded = parts.values.dictionary_encode()
        words = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        self.learn(words)
        ids = [self.known[w] for w in words]
        flat = np.frombuffer(b"".join(ids), "<u4")
        lengths = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        at = coded.indices.to_numpy()
        # ids of all texts in a row: the run of each word, taken out of ``flat``
        runs = lengths[at]
        before = np.cumsum(runs) - runs
        pick = np.repeat((np.cumsum(lengths) - lengths)[at] - before, runs) + np.arange(runs.sum())
        bounds = np.append(before, runs.sum())[parts.offsets.to_numpy()]
        end = np.array([end_id], "<u4")
        stream = flat[pick]
        out = [np.concatenate([stream[a:b], end]) for a, b in zip(bounds, bounds[1:])]
        for i in whole:
            found = self.tokenizer.encode(texts[i], add_special_tokens=False).ids
            out[i] = np.array([*found, end_id], "<u4")
        while len(self.known) > CACHE_WORDS:
            self.known.popitem()  # the last that came
        return out


_WORDS: dict[str, Words] = {}


def words_of(path: str) -> Words:
    if path not in _WORDS:
        _WORDS[path] = Words(path)
    return _WORDS[path]


# -- codes -------------------------------------------------------------------------


def code_lengths(counts: np.ndarray, limit: int) -> np.ndarray:
    """Optimal code lengths of at most ``limit`` bits by package-merge; 0 for count 0.

    Ties go to the lower id, so equal counts give equal lengths on every run.
    """
    used = np.flatnonzero(counts)
    lengths = np.zeros(len(counts), np.int64)
    n = len(used)
    if n <= 1:
        lengths[used] = 1
        return lengths
    if n > 1 << limit:
        raise ValueError(f"{n} ids need codes of more than {limit} bits")
    order = used[np.argsort(counts[used], kind="stable")]
    leaves = counts[order].astype(np.float64)
    level, is_leaf = leaves, [np.ones(n, bool)]
    for _ in range(limit - 1):
        even = len(level) // 2 * 2
        both = np.concatenate([leaves, level[0:even:2] + level[1:even:2]])
        at = np.argsort(both, kind="stable")
        level = both[at]
        is_leaf.append(at < n)
    take = 2 * n - 2
    for flags in reversed(is_leaf):
        chosen = int(flags[:take].sum())
        lengths[order[:chosen]] += 1
        take = 2 * (take - chosen)
    return lengths


class Code:
    """Canonical codes of given lengths, and the table that decodes them."""

    def __init__(self, lengths: np.ndarray):
        self.lengths = np.asarray(lengths, np.int64)
        ids = np.flatnonzero(self.lengths)
        ids = ids[np.argsort(self.lengths[ids], kind="stable")]
        size = self.lengths[ids]
        self.width = int(size.max()) if len(ids) else 1
        span = np.left_shift(1, self.width - size)
        first = np.concatenate([[0], np.cumsum(span)[:-1]]) if len(ids) else span
        self.codes = np.zeros(len(self.lengths), np.uint64)
        self.codes[ids] = np.right_shift(first, self.width - size)
        self.table_ids = np.zeros(1 << self.width, np.uint32)
        self.table_lengths = np.zeros(1 << self.width, np.int64)
        used = int(span.sum())
        self.table_ids[:used] = np.repeat(ids, span)
        self.table_lengths[:used] = np.repeat(size, span)

    def encode(self, docs: list[np.ndarray]) -> list[tuple[bytes, bytes]]:
        """Per document its bit stream, and the bit offsets of its blocks as int64 bytes."""
        count = np.array([len(d) for d in docs])
        ids = np.concatenate([*docs, np.zeros(0, np.uint32)])
        if not len(ids):
            return [(b"", b"")] * len(docs)
        size = self.lengths[ids]
        ends = np.concatenate([[0], np.cumsum(size)])
        doc_at = np.concatenate([[0], np.cumsum(count)])
        doc_bytes = (ends[doc_at[1:]] - ends[doc_at[:-1]] + 7) // 8
        byte_at = np.concatenate([[0], np.cumsum(doc_bytes)])
        within = ends[:-1] - np.repeat(ends[doc_at[:-1]], count)
        at = within + np.repeat(byte_at[:-1] * 8, count)
        word, room = at >> 6, 64 - (at & 63) - size
        value = self.codes[ids]
        bits = np.where(
            room >= 0,
            value << np.maximum(room, 0).astype(np.uint64),
            value >> np.maximum(-room, 0).astype(np.uint64),
        )
        out = np.zeros(int(byte_at[-1]) // 8 + 2, np.uint64)
        starts = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
        out[word[starts]] = np.bitwise_or.reduceat(bits, starts)
        over = np.flatnonzero(room < 0)
        out[word[over] + 1] |= value[over] << (64 + room[over]).astype(np.uint64)
        stream = out.astype(">u8").tobytes()
        return [
            (stream[byte_at[i] : byte_at[i + 1]], within[doc_at[i] : doc_at[i + 1] : BLOCK_IDS].tobytes())
            for i in range(len(docs))
        ]

    def decode(self, payload: bytes, at: np.ndarray, count: np.ndarray) -> np.ndarray:
        """Ids of blocks that start at bit offsets ``at`` and hold ``count`` ids each.

        All blocks advance together; the ids come out block after block.
        """
        padded = payload + b"\0" * (12 - len(payload) % 4)
        words = np.frombuffer(padded, ">u4").astype(np.uint64)
        pairs = (words[:-1] << np.uint64(32)) | words[1:]
        order = np.argsort(-count, kind="stable")
        at, left = at[order].copy(), count[order]
        place = (np.cumsum(count) - count)[order]
        out = np.zeros(int(count.sum()), np.uint32)
        mask = np.uint64((1 << self.width) - 1)
        for step in range(int(left[0]) if len(left) else 0):
            live = int(np.searchsorted(-left, -step, side="left"))
            here = at[:live]
            window = (pairs[here >> 5] >> (64 - self.width - (here & 31)).astype(np.uint64)) & mask
            out[place[:live] + step] = self.table_ids[window]
            here += self.table_lengths[window]
        return out


# -- writing -----------------------------------------------------------------------


TOKENIZED = "doc_id long, n_tokens long, ids binary"


def tokenize(docs: DataFrame, path: str, end_id: int) -> DataFrame:
    """``doc_id, n_tokens, ids`` (little-endian, two bytes an id where the vocabulary allows)."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        words = words_of(path)
        kind = id_kind(max(words.tokenizer.get_vocab_size(), end_id + 1))
        ids = words.encode_all([t or "" for t in batch.column(1).to_pylist()], end_id)
        return pa.RecordBatch.from_arrays(
            [
                batch.column(0),
                pa.array([len(x) for x in ids], pa.int64()),
                pa.array([x.astype(kind).tobytes() for x in ids], pa.binary()),
            ],
            ["doc_id", "n_tokens", "ids"],
        )

    return map_slices(docs, run, TOKENIZED, budget=4 << 20)


def id_kind(vocabulary: int) -> str:
    return "<u2" if vocabulary <= 1 << 16 else "<u4"


def _ids(batch: pa.RecordBatch) -> list[np.ndarray]:
    """The ids of the rows of ``doc_id, n_tokens, ids``."""
    return [
        np.frombuffer(x, "<u2" if len(x) == 2 * n else "<u4")
        for x, n in zip(batch.column(2).to_pylist(), batch.column(1).to_pylist(), strict=True)
    ]


def id_counts(tokenized: DataFrame) -> DataFrame:
    """``id, n``: occurrences of every id over the whole corpus, end ids included."""

    def run(batches):
        total = np.zeros(0, np.int64)
        for piece in in_slices(batches, "ids", 2 << 20):
            more = np.bincount(np.concatenate(_ids(piece)), minlength=len(total))
            more[: len(total)] += total
            total = more
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], ["id", "n"])

    return tokenized.mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))


def _containers(batches):
    """Rows of one file, in order, gathered into containers of whole documents."""
    start = seq = 0
    rows: list[dict] = []
    held = 0

    def close():
        return pa.RecordBatch.from_pylist(
            [
                {
                    "file_no": rows[0]["pid"],
                    "seq": seq,
                    "start_in_file": start,
                    "doc_ids": [r["doc_id"] for r in rows],
                    "n_tokens": [r["n_tokens"] for r in rows],
                    "doc_bytes": [len(r["payload"]) for r in rows],
                    "payload": b"".join(r["payload"] for r in rows),
                    "checkpoints": b"".join(r["checkpoints"] for r in rows),
                }
            ],
            schema=CONTAINER_ARROW,
        )

    for batch in in_slices(batches, "payload", 1 << 20):
        for row in batch.to_pylist():
            if rows and (held + row["n_tokens"] > CONTAINER_IDS or row["pid"] != rows[0]["pid"]):
                yield close()
                start, seq = (start + held, seq + 1) if row["pid"] == rows[0]["pid"] else (0, 0)
                rows, held = [], 0
            rows.append(row)
            held += row["n_tokens"]
    if rows:
        yield close()


CONTAINER_ARROW = pa.schema(
    [
        ("file_no", pa.int32()),
        ("seq", pa.int32()),
        ("start_in_file", pa.int64()),
        ("doc_ids", pa.list_(pa.int64())),
        ("n_tokens", pa.list_(pa.int64())),
        ("doc_bytes", pa.list_(pa.int64())),
        ("payload", pa.binary()),
        ("checkpoints", pa.binary()),
    ]
)


def write_token_files(
    docs: DataFrame, path: str, tokenizer: str | None = None, end_id: int = END_ID, files: int | None = None
) -> None:
    """Encode every whole text and write ``path/codebook`` and ``path/containers``.

    ``files`` is the number of ``doc_id`` ranges (the session's shuffle partitions by
    default). Shuffles the Huffman streams once, not the texts.
    """
    spark = docs.sparkSession
    tokenizer = tokenizer or public_tokenizers.path(TOKENIZER_FILE)
    files = files or int(spark.conf.get("spark.sql.shuffle.partitions"))
    docs = docs.select(F.col("doc_id").cast("long"), "text")

    tokenized = materialize(tokenize(docs, tokenizer, end_id), "token-ids")
    found = id_counts(tokenized).toPandas()  # one row per used vocabulary entry
    counts = np.zeros(int(found["id"].max()) + 1 if len(found) else 0, np.int64)
    counts[found["id"].to_numpy(int)] = found["n"].to_numpy()
    limit = max(LIMIT, int(np.count_nonzero(counts)).bit_length() + 1)
    lengths = code_lengths(counts, limit)
    spark.createDataFrame(
        pd.DataFrame({"id": np.arange(len(lengths)), "length": lengths}), "id long, length int"
    ).coalesce(1).write.parquet(f"{path}/codebook")

    shares = [i / files for i in range(1, files)]
    cuts = tokenized.agg(F.percentile_approx("doc_id", shares, 100 * files)).first()[0] if shares else None
    bounds = np.array(cuts or [], np.int64)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        coded = code_of(lengths).encode([x.astype(np.uint32) for x in _ids(batch)])
        where = np.searchsorted(bounds, batch.column(0).fill_null(-(2**63)).to_numpy(), side="left")
        return pa.RecordBatch.from_arrays(
            [
                pa.array(where.astype(np.int32)),
                batch.column(0),
                batch.column(1),
                pa.array([c[0] for c in coded], pa.binary()),
                pa.array([c[1] for c in coded], pa.binary()),
            ],
            ["pid", "doc_id", "n_tokens", "payload", "checkpoints"],
        )

    dealt = map_slices(tokenized, run, CODED, column="ids").repartitionById(files, F.col("pid"))
    ordered = dealt.sortWithinPartitions("pid", "doc_id", "n_tokens", "payload")
    ordered.mapInArrow(_containers, CONTAINER).write.parquet(f"{path}/containers")


_CODES: dict[bytes, Code] = {}


def code_of(lengths: np.ndarray) -> Code:
    """The code of these lengths, built once per Python worker."""
    key = np.asarray(lengths, np.uint8).tobytes()
    if key not in _CODES:
        _CODES.clear()
        _CODES[key] = Code(lengths)
    return _CODES[key]


# -- reading -----------------------------------------------------------------------


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, start, n_tokens, token_ids`` (little-endian 32-bit) from written files.

    ``start`` is the number of ids of all documents before this one.
    """
    book = spark.read.parquet(f"{path}/codebook").orderBy("id").toPandas()
    lengths = book["length"].to_numpy(np.int64)
    containers = spark.read.schema(CONTAINER).parquet(f"{path}/containers")
    sizes = containers.groupBy("file_no").agg(
        F.sum(F.aggregate("n_tokens", F.lit(0).cast("long"), lambda a, b: a + b)).alias("n")
    ).toPandas()  # one row per file
    sizes = sizes.sort_values("file_no")
    base = dict(zip(sizes["file_no"].tolist(), (sizes["n"].cumsum() - sizes["n"]).tolist(), strict=True))

    def run(batches):
        code = code_of(lengths)
        for batch in batches:
            for row in batch.to_pylist():
                count = np.array(row["n_tokens"], np.int64)
                blocks = -(-count // BLOCK_IDS)
                size = np.full(int(blocks.sum()), BLOCK_IDS, np.int64)
                last = np.cumsum(blocks) - 1
                size[last[blocks > 0]] = (count - (blocks - 1) * BLOCK_IDS)[blocks > 0]
                bits = 8 * (np.cumsum(row["doc_bytes"]) - row["doc_bytes"])
                at = np.frombuffer(row["checkpoints"], np.int64) + np.repeat(bits, blocks)
                ids = code.decode(row["payload"], at, size).astype("<u4").tobytes()
                ends = np.cumsum(count)
                start = base[row["file_no"]] + row["start_in_file"] + ends - count
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(row["doc_ids"], pa.int64()),
                        pa.array(start, pa.int64()),
                        pa.array(count),
                        pa.array([ids[4 * (e - c) : 4 * e] for e, c in zip(ends.tolist(), count.tolist(), strict=True)], pa.binary()),
                    ],
                    ["doc_id", "start", "n_tokens", "token_ids"],
                )

    return containers.mapInArrow(run, READ)


def digests(read: DataFrame) -> DataFrame:
    """The contract columns of operator 9 from the files read back."""
    return read.select("doc_id", "start", "n_tokens", F.crc32("token_ids").alias("ids_crc32"))
