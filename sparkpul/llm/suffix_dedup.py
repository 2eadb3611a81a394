"""Removal of repeated byte strings by suffix arrays of content-defined buckets (operator 5).

A byte is removed if a string of ``length`` bytes around it also starts at another place
of the corpus. No task holds the corpus, so windows (strings of that length, one per
start) are first dealt to buckets such that equal windows share one:

* the anchor of a window is its leftmost ``GRAM``-byte substring of least hash. Equal
  windows have equal anchors at equal offsets, and neighbouring windows mostly share
  theirs, so a text falls into segments: runs of windows of one anchor, whose bytes are
  one string of ``length`` to about twice as many bytes. The bucket is the anchor's hash;
* segments with the same bytes are counted, not collected: if two places have them, all
  their windows repeat. A bucket with one distinct string needs nothing more;
* for any other bucket, the distinct strings are joined to one text and sorted by a suffix
  array (linear grouping, see ``suffix_sort``). Windows with equal bytes are neighbours
  there, which finds the repeats inside segments that differ, at the ends of copied
  passages. Many buckets are sorted together, a round of numpy calls for all of them, until
  the largest is done; so tasks get buckets of about the same size, and enough of them;
* a bucket whose distinct strings exceed ``BUCKET_BYTES`` (one passage with very many
  edits) is split: windows with nearby anchor offsets have a longer common core, whose
  bytes name a smaller bucket of shorter strings. At width one a bucket holds one window.

The texts are read once for the segments, moved once to cut the distinct strings of
shared buckets, and once to cut the repeats out; both times only documents that a Bloom
filter lets pass. Everything else is rows of hashes.

Defined results: null text is empty; texts shorter than ``length`` keep all bytes; rows
that are equal in all are documents of their own and repeat each other; a null id is an
id; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkpul.llm.bloom import BlockedBloom
from sparkpul.llm.common import map_slices, materialize
from sparkpul.llm.suffix_sort import suffix_arrays

LENGTH = 400
#: bytes of the substring whose hash anchors a window
GRAM = 96
#: most bytes of a bucket's distinct strings for one suffix array
BUCKET_BYTES = 32 << 10
#: most bytes sorted together, and bytes of a task if partitions suffice (one batch)
BATCH_BYTES = 2 << 20
TASK_BYTES = 3 << 19
#: widths of offset ranges that crowded buckets are split by, in turn
WIDTHS = (32, 4, 1)
BASE = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))

SEGMENT = "key long, string_hash binary, doc_id long, text_hash long, a int, b int, p int"
CUT = "key long, doc_id long, text_hash long, a int, p int, n long, bytes long, string binary"
SPAN = "doc_id long, text_hash long, a int, b int"


# -- anchors and segments ------------------------------------------------------------


def gram_hashes(data: np.ndarray, size: int) -> np.ndarray:
    """A 64-bit hash of the ``size`` bytes from each place on, places with fewer left out."""
    if len(data) < size:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        down = np.cumprod(np.full(len(data), INVERSE))
        up = np.cumprod(np.full(len(data) - size + 1, BASE))
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * down)])
        h = (sums[size:] - sums[:-size]) * up
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(32)
        h *= np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(29))


def least_places(values: np.ndarray, width: int) -> np.ndarray:
    """Place of the leftmost least of ``values[s : s + width]`` for every s that has them all."""
    n = len(values)
    if n < width:
        return np.zeros(0, np.int64)
    keyed = (values & ~np.uint64(0xFFFFFFFF)) | np.arange(n, dtype=np.uint64)
    padded = np.concatenate([keyed, np.full(-n % width, np.uint64(2**64 - 1))]).reshape(-1, width)
    ahead = np.minimum.accumulate(padded, axis=1).ravel()
    behind = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()
    least = np.minimum(behind[: n - width + 1], ahead[width - 1 : n])
    return (least & np.uint64(0xFFFFFFFF)).astype(np.int64)


def text_segments(data: np.ndarray, ends: np.ndarray, length: int, gram: int):
    """Segments of texts that lie one after the other in ``data``.

    Returns, per segment, its text, first and last window, anchor (places in ``data``)
    and the anchor's hash.
    """
    starts = np.concatenate([[0], ends[:-1]])
    hashes = gram_hashes(data, gram)
    anchor = least_places(hashes, length - gram + 1)
    count = np.maximum(ends - starts - length + 1, 0)
    text = np.repeat(np.arange(len(ends)), count)
    window = np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(starts, count)
    if not len(window):
        none = np.zeros(0, np.int64)
        return none, none, none, none, np.zeros(0, np.uint64)
    anchor = anchor[window]
    new = np.ones(len(window), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1])
    head = np.flatnonzero(new)
    tail = np.append(head[1:], len(window)) - 1
    return text[head], window[head], window[tail], anchor[head], hashes[anchor[head]]


def _digests(data: bytes, a: np.ndarray, b: np.ndarray) -> list[bytes]:
    digest = xxhash.xxh3_128_digest
    view = memoryview(data)
    return [digest(view[x:y]) for x, y in zip(a.tolist(), b.tolist(), strict=True)]


def segments(docs: DataFrame, length: int, gram: int) -> DataFrame:
    """Segments of all texts; ``a, b`` first and last window, ``p`` anchor, by byte in the text."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = [(t or "").encode() for t in batch.column(2).to_pylist()]
        data = b"".join(texts)
        ends = np.cumsum([len(t) for t in texts])
        text, a, b, p, key = text_segments(np.frombuffer(data, np.uint8), ends, length, gram)
        start = np.concatenate([[0], ends[:-1]])[text] if len(text) else a
        at = pa.array(text)
        return pa.RecordBatch.from_arrays(
            [
                pa.array(key.view(np.int64)),
                pa.array(_digests(data, a, b + length), pa.binary()),
                batch.column(0).take(at),
                batch.column(1).take(at),
                *(pa.array((x - start).astype(np.int32)) for x in (a, b, p)),
            ],
            ["key", "string_hash", "doc_id", "text_hash", "a", "b", "p"],
        )

    return map_slices(docs, run, SEGMENT)


def cut_strings(texts: DataFrame, length: int) -> DataFrame:
    """The strings of ``texts.wanted`` (structs ``key, a, b, p, n, bytes``), one row each."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for doc_id, text_hash, text, wanted in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            data = (text or "").encode()
            rows += [
                (w["key"], doc_id, text_hash, w["a"], w["p"], w["n"], w["bytes"], data[w["a"] : w["b"] + length])
                for w in wanted
            ]
        columns = zip(*rows, strict=True) if rows else [[]] * 8
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary()]
        return pa.RecordBatch.from_arrays(
            [pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)],
            ["key", "doc_id", "text_hash", "a", "p", "n", "bytes", "string"],
        )

    return map_slices(texts.select("doc_id", "text_hash", "text", "wanted"), run, CUT)


def split_strings(crowded: DataFrame, length: int, width: int) -> DataFrame:
    """Segments of windows whose anchor offsets lie in one range of ``width``."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        for row in batch.to_pylist():
            data, a, p = row["string"], row["a"], row["p"]
            b = a + len(data) - length
            for part in range((p - b) // width, (p - a) // width + 1):
                first, last = max(a, p - (part + 1) * width + 1), min(b, p - part * width)
                core = data[p - part * width - a : p - (part + 1) * width + 1 + length - a]
                string = data[first - a : last - a + length]
                key = xxhash.xxh3_64_intdigest(core, part) - (1 << 63)
                out.append((
                    key, xxhash.xxh3_128_digest(string), row["doc_id"], row["text_hash"], first, last, p, string,
                ))
        columns = zip(*out, strict=True) if out else [[]] * 8
        kinds = [pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary()]
        return pa.RecordBatch.from_arrays(
            [pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)],
            ["key", "string_hash", "doc_id", "text_hash", "a", "b", "p", "string"],
        )

    return map_slices(crowded, run, SEGMENT + ", string binary", column="string", budget=256 << 10)


# -- suffix arrays of buckets --------------------------------------------------------


def repeated_windows(buckets: list[list[bytes]], length: int) -> list[list[np.ndarray]]:
    """For each string of each bucket, which of its windows stand elsewhere in the bucket."""
    by_size = sorted(range(len(buckets)), key=lambda i: sum(map(len, buckets[i])))
    # the symbols of a text: 0 its end, 1 between strings, 2 and up the bytes
    strings = [s for i in by_size for s in buckets[i]]
    sizes = np.array([len(s) + 1 for s in strings])
    ends = np.cumsum(sizes)
    first = ends - sizes
    flat = np.frombuffer(b"\0".join([*strings, b""]), np.uint8)
    symbols = flat.astype(np.int32) + 2
    symbols[ends - 1] = 1
    members = np.cumsum([len(buckets[i]) for i in by_size])
    starts = np.concatenate([[0], ends[members - 1]])
    symbols[starts[1:] - 1] = 0
    order = suffix_arrays(symbols, starts)

    repeated = np.zeros(len(symbols), bool)
    count = sizes - length  # windows of a string
    window = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count) + np.repeat(first, count)
    whole = np.zeros(len(symbols), bool)
    whole[window] = True
    one, two = gram_hashes(flat, length), gram_hashes(flat ^ 0x5A, length)
    pad = np.zeros(len(symbols) - len(one), np.uint64)
    one, two = np.concatenate([one, pad]), np.concatenate([two, pad])
    text = np.repeat(np.arange(len(buckets)), np.diff(starts))
    left, right = order[:-1], order[1:]
    same = whole[left] & whole[right] & (text[left] == text[right])
    same &= (one[left] == one[right]) & (two[left] == two[right])
    repeated[left[same]] = True
    repeated[right[same]] = True

    out: list = [None] * len(buckets)
    at = 0
    for i in by_size:
        out[i] = []
        for _ in buckets[i]:
            out[i].append(repeated[first[at] : first[at] + count[at]])
            at += 1
    return out


def bucket_spans(strings: DataFrame, length: int, partitions: int) -> DataFrame:
    """Spans covered by repeated windows inside strings that occur once (``n`` = 1).

    ``bytes`` is the size of a string's bucket. Equal rows of the table cut the same strings;
    a bucket takes each once."""

    def solve(held: list[list[dict]]):
        rows = []
        found = repeated_windows([[r["string"] for r in bucket] for bucket in held], length)
        for bucket, masks in zip(held, found, strict=True):
            for r, mask in zip(bucket, masks, strict=True):
                if r["n"] > 1 or not mask.any():
                    continue
                edge = np.diff(np.concatenate([[0], mask.view(np.int8), [0]]))
                for x, y in zip(np.flatnonzero(edge > 0).tolist(), np.flatnonzero(edge < 0).tolist(), strict=True):
                    rows.append((r["doc_id"], r["text_hash"], r["a"] + x, r["a"] + y - 1 + length))
        columns = zip(*rows, strict=True) if rows else [[]] * 4
        return pa.RecordBatch.from_arrays(
            [pa.array(list(c), k) for c, k in zip(columns, [pa.int64(), pa.int64(), pa.int32(), pa.int32()], strict=True)],
            ["doc_id", "text_hash", "a", "b"],
        )

    def run(batches):
        held: list[list[dict]] = []
        places: set[tuple] = set()
        size = 0
        for batch in batches:
            for row in batch.to_pylist():
                if not held or held[-1][0]["key"] != row["key"]:
                    if size >= BATCH_BYTES:
                        yield solve(held)
                        held, size = [], 0
                    held.append([])
                    places = set()
                place = row["doc_id"], row["text_hash"], row["a"]
                if place in places:
                    continue
                places.add(place)
                held[-1].append(row)
                size += len(row["string"])
        if held:
            yield solve(held)

    dealt = strings.select("bytes", "key", "doc_id", "text_hash", "a", "n", "string")
    dealt = dealt.repartitionByRange(partitions, "bytes", "key").sortWithinPartitions("bytes", "key")
    return dealt.mapInArrow(run, SPAN)


# -- the corpus ----------------------------------------------------------------------


def _counted(rows: DataFrame, length: int, carried: list[str]) -> tuple[DataFrame, DataFrame]:
    """Spans of segments that occur more than once; distinct strings of buckets that need sorting."""
    strings = materialize(
        rows.groupBy("key", "string_hash").agg(
            F.count("*").alias("n"), *[F.first(c).alias(c) for c in ("doc_id", "text_hash", "a", "b", "p", *carried)]
        ),
        "strings",
    )
    again = strings.where("n > 1").select("key", "string_hash")
    spans = rows.join(again, ["key", "string_hash"], "left_semi").select(
        "doc_id", "text_hash", "a", (F.col("b") + length).alias("b")
    )
    shared = strings.groupBy("key").agg(
        F.count("*").alias("members"), F.min("n").alias("least"), F.sum(F.col("b") - F.col("a") + length).alias("bytes")
    ).where("members > 1 and least = 1").select("key", "bytes")
    return spans, strings.join(shared, "key")


def repeated_spans(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """``doc_id, text_hash, a, b``: byte ranges covered by strings of ``length`` bytes that
    start in more than one place. Ranges of a document may overlap."""
    partitions = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keyed = _keyed(docs)
    rows = materialize(segments(keyed, length, gram), "segments")
    spans, members = _counted(rows, length, [])
    wanted = materialize(
        members.groupBy("doc_id", "text_hash").agg(
            F.collect_list(F.struct("key", "a", "b", "p", "n", "bytes")).alias("wanted")
        ),
        "wanted",
    )
    texts = BlockedBloom(wanted, "text_hash").possible(keyed, "text_hash")
    w = wanted.select(F.col("doc_id").alias("id"), F.col("text_hash").alias("hash"), "wanted")
    found = texts.join(w, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("text_hash") == F.col("hash")))
    sized = materialize(cut_strings(found, length), "bucket-strings")
    for width in WIDTHS:
        fits = F.col("bytes") <= BUCKET_BYTES
        size, crowded = sized.agg(F.sum(F.when(fits, F.length("string"))), F.max(~fits)).first()
        tasks = min(partitions, -(-(size or 0) // TASK_BYTES))
        if tasks:
            spans = spans.unionByName(bucket_spans(sized.where(fits), length, tasks))
        if not crowded:
            return spans
        rows = materialize(split_strings(sized.where(~fits), length, width), "split-segments")
        more, members = _counted(rows, length, ["string"])
        spans = spans.unionByName(more)
        sized = materialize(members.select("key", "doc_id", "text_hash", "a", "p", "n", "bytes", "string"), "split-strings")
    # at width one a bucket's windows are all equal, so none has two distinct strings
    return spans


def _keyed(docs: DataFrame) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    return docs.select(F.col("doc_id").cast("long"), F.xxhash64(text).alias("text_hash"), text.alias("text"))


def _cut_out(batch: pa.RecordBatch) -> pa.RecordBatch:
    rows = []
    for doc_id, text, spans in zip(*(c.to_pylist() for c in batch.columns), strict=True):
        data = text.encode()
        kept, removed, runs, at = [], 0, 0, 0
        last = -1
        for s in sorted((s["a"], s["b"]) for s in spans or []):
            if s[0] > last:
                runs += 1
            if s[1] > at:
                start = max(at, s[0])
                kept.append(data[at:start])
                removed += s[1] - start
                at = s[1]
            last = max(last, s[1])
        kept.append(data[at:])
        rows.append((doc_id, len(data), removed, runs, b"".join(kept)))
    columns = zip(*rows, strict=True) if rows else [[]] * 5
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
    return pa.RecordBatch.from_arrays(
        [pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)],
        ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"],
    )


def remove_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept`` of every document."""
    found = materialize(
        repeated_spans(docs, length, gram).groupBy("doc_id", "text_hash").agg(
            F.collect_set(F.struct("a", "b")).alias("spans")
        ),
        "repeated-spans",
    )
    s = found.select(F.col("doc_id").alias("id"), F.col("text_hash").alias("hash"), "spans")
    marked = BlockedBloom(found, "text_hash").marked(_keyed(docs), "text_hash", "maybe")
    touched = marked.where("maybe").join(
        s, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("text_hash") == F.col("hash")), "left"
    )
    cut = map_slices(
        touched.select("doc_id", "text", "spans"), _cut_out,
        "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary",
    )
    data = F.col("text").cast("binary")
    zero = F.lit(0).cast("long")
    whole = marked.where("not maybe").select(
        "doc_id", F.length(data).cast("long").alias("n_bytes"), zero.alias("n_removed"), zero.alias("n_spans"),
        data.alias("kept"),
    )
    return cut.unionByName(whole)


def digests(found: DataFrame) -> DataFrame:
    """The contract columns of operator 5."""
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
