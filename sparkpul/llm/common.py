"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from sparkpul.session import materialize

__all__ = ["SPACE_CLASS", "ascii_lower", "free_name", "in_slices", "let", "map_slices", "materialize", "packed", "remembers", "table"]

#: white space of the word rule ``[^\\x20\\x09-\\x0D]+``
SPACE_CLASS = r"[\x20\x09-\x0D]"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z only."""
    return F.translate(c, UPPER, LOWER)


def packed(df: DataFrame, **keys: Column) -> DataFrame:
    """``df`` as a struct column ``row`` beside ``keys``: whatever its columns are called,
    they cannot clash with those of an operator. ``select("row.*")`` gives them back."""
    columns = [df[f"`{c.replace('`', '``')}`"] for c in df.columns]
    return df.select(F.struct(*columns).alias("row"), *[key.alias(name) for name, key in keys.items()])


def free_name(df: DataFrame, name: str) -> str:
    """``name``, lengthened until no column of ``df`` has it in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once: inside a lambda of a higher-order
    function an outer expression would be computed again for every element."""
    return F.get(F.transform(F.array(value), body), 0)


def in_slices(batches: Iterator[pa.RecordBatch], column: str, budget: int) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches into runs of rows whose ``column`` holds about ``budget`` bytes.

    A row is never cut, so a longer text is a slice of its own; memory in a task follows
    the budget or the longest text, not the batch.
    """
    for batch in batches:
        texts = batch.column(batch.schema.get_field_index(column))
        size, first = 0, 0
        for i, length in enumerate(pc.binary_length(texts).to_pylist()):
            size += length or 0
            if size >= budget:
                yield batch.slice(first, i + 1 - first)
                size, first = 0, i + 1
        if first < batch.num_rows:
            yield batch.slice(first)


#: what operators remember in a Python worker, by module: how to drop it
_REMEMBERED: dict[str, Callable[[], None]] = {}


def remembers(module: str, drop: Callable[[], None]) -> None:
    """``module`` keeps something between the tasks of a worker; ``drop`` frees it."""
    _REMEMBERED[module] = drop


def _enter(module: str) -> None:
    """A worker that goes on to another operator drops what the others remember, so that
    its memory is that of one operator."""
    for other, drop in _REMEMBERED.items():
        if other != module:
            drop()


def map_slices(
    df: DataFrame,
    fn: Callable[[pa.RecordBatch], pa.RecordBatch],
    schema: str | StructType,
    column: str = "text",
    budget: int = 2 << 20,
) -> DataFrame:
    """``mapInArrow`` that hands ``fn`` slices of about ``budget`` bytes of text."""

    module = fn.__module__

    def run(batches):
        _enter(module)
        for piece in in_slices(batches, column, budget):
            yield fn(piece)

    return df.mapInArrow(run, schema)
