"""Fill-in-the-middle transformation: a text is cut in three and its middle moved to the end.

A text is a row of units, runs of the letters A-Z and a-z or single other characters. One
``fullmatch`` of ``(unit)*`` by the regex library keeps every repetition of the group, so
``match.ends(1)`` holds the end of each unit: its length is ``n``, and the two cut offsets
are two of its entries. The match keeps about 140 bytes a unit and the library refuses
states beyond some hundred megabytes, so a text of more than ``SECTION`` code points is
matched section by section. Sections end where a unit ends, so the units are those of the
whole text; a shorter text, which nearly every one is, is a single match.

The cuts and the form of a row follow from the SHA-256 of the seed and its id alone: runs
repeat, and a lost task gives the same rows again. The work is one pass without a shuffle.

Odd rows: a null text counts as empty and an empty text is plain; a null id hashes as the
empty string; rows with equal ids get the same draws; repeated rows stay. Texts that hold
a mark stay plain, so the marks of an output are always its own. Other columns of the input
are carried as they are, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from sparkpul.llm.common import map_slices

UNITS = regex.compile(r"([A-Za-z]++|[^A-Za-z])*")
LETTERS = regex.compile(r"[A-Za-z]*+")
#: code points of one match
SECTION = 1 << 18
#: marks of prefix, suffix and middle
MARKS = ("<P>", "<S>", "<M>")
COLUMNS = ("n", "form", "prefix_chars", "middle_chars", "output")
#: percent of rows that are transformed, and of these that put the suffix first
RATE, SPM_RATE = 90, 20


def unit_ends(text: str, section: int = SECTION) -> np.ndarray:
    """The end of every unit of ``text``, in code points."""
    found, start = [], 0
    while True:
        stop = min(start + section, len(text))
        if stop < len(text) and LETTERS.fullmatch(text, stop - 1, stop):
            # a run of letters over the border belongs to this section
            stop = LETTERS.match(text, stop).end()
        found.append(np.array(UNITS.fullmatch(text, start, stop).ends(1), dtype=np.int64))
        if stop == len(text):
            return found[0] if len(found) == 1 else np.concatenate(found)
        start = stop


def cut(text: str, h: tuple[int, int, int, int], rate: int = RATE, spm_rate: int = SPM_RATE):
    """``(n, form, prefix_chars, middle_chars, output)`` of a text for its four draws."""
    ends = unit_ends(text)
    n = len(ends)
    if not n or h[2] % 100 >= rate or any(m in text for m in MARKS):
        return n, "plain", None, None, text
    first, second = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    a, b = (int(ends[i - 1]) if i else 0 for i in (first, second))
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    p, s, m = MARKS
    if h[3] % 100 < spm_rate:
        return n, "spm", a, b - a, f"{s}{suffix}{p}{prefix}{m}{middle}"
    return n, "psm", a, b - a, f"{p}{prefix}{s}{suffix}{m}{middle}"


def restore(output: str, form: str) -> str:
    """The text that ``cut`` gave as ``output`` in ``form``."""
    if form == "plain":
        return output
    p, s, m = MARKS
    head, middle = output.split(m, 1)
    if form == "spm":
        suffix, prefix = head.removeprefix(s).split(p, 1)
    else:
        prefix, suffix = head.removeprefix(p).split(s, 1)
    return prefix + middle + suffix


def _draws(seed: int, key: Column) -> Column:
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256)
    return F.array(*[F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("long") for i in range(4)])


def fill_in_middle(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    seed: int = 1,
    rate: int = RATE,
    spm_rate: int = SPM_RATE,
) -> DataFrame:
    """``row`` (the input columns but the text, as a struct), ``n``, ``form``,
    ``prefix_chars``, ``middle_chars`` and ``output``: every text transformed."""
    rest = [docs[f"`{c}`"] for c in docs.columns if c != text_col]
    packed = docs.select(
        F.struct(*rest).alias("row"),
        _draws(seed, F.col(id_col)).alias("draws"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
    )
    schema = StructType([packed.schema["row"]])
    for name, kind in zip(COLUMNS, (LongType(), StringType(), LongType(), LongType(), StringType()), strict=True):
        schema = schema.add(name, kind)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        draws, texts = batch.column(1).to_pylist(), batch.column(2).to_pylist()
        n, form, prefix, middle, output = zip(
            *[cut(t, h, rate, spm_rate) for t, h in zip(texts, draws)], strict=True
        )
        numbers, words = pa.int64(), pa.string()
        columns = [
            batch.column(0),
            pa.array(n, numbers),
            pa.array(form, words),
            pa.array(prefix, numbers),
            pa.array(middle, numbers),
            pa.array(output, words),
        ]
        return pa.RecordBatch.from_arrays(columns, ["row", *COLUMNS])

    return map_slices(packed, run, schema)


def restored(transformed: DataFrame) -> DataFrame:
    """The columns of ``fill_in_middle`` with ``restored``, the text rebuilt from output and form."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        pairs = zip(batch.column("output").to_pylist(), batch.column("form").to_pylist(), strict=True)
        return batch.append_column("restored", pa.array([restore(o, f) for o, f in pairs], pa.string()))

    schema = StructType([*transformed.schema, StructField("restored", StringType())])
    return map_slices(transformed, run, schema, "output")


def digests(transformed: DataFrame) -> DataFrame:
    """One row per document: counts, form, cuts and the digests of output and rebuilt text."""
    return restored(transformed).select(
        F.col("row.doc_id").alias("doc_id"),
        "n",
        "form",
        "prefix_chars",
        "middle_chars",
        F.sha2("output", 256).alias("output_sha256"),
        F.sha2("restored", 256).alias("restored_sha256"),
    )
