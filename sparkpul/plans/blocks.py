"""Feature rows packed into binary blocks, for fits that read the same rows many times.

A block is one row of a table: the number of rows it holds, their features and further
numeric columns as row-major float64 bytes. A pass over blocks costs no conversion of
lists and hands numpy whole matrices; a block never breaks between tasks, and its size is
bounded whatever the table's.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize, ship_package

#: bytes of the features of a block, about
BLOCK_BYTES = 4 << 20
#: rows of results that go straight to the driver; more are added up on executors first
DIRECT_ROWS = 64
#: bytes of results that go straight to the driver
DIRECT_BYTES = 32 << 20


def matrix(column: pa.Array) -> np.ndarray:
    """The rows of a list column without nulls as a matrix."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    rows = len(column)
    if rows and len(flat) % rows:
        raise ValueError("vectors of unequal length")
    return flat.reshape(rows, -1)


def unpack(batch: pa.RecordBatch, names: Sequence[str]) -> Iterator[tuple]:
    """The blocks of an Arrow batch: row count and one matrix per name."""
    for i in range(batch.num_rows):
        n = batch.column("n")[i].as_py()
        yield n, *[np.frombuffer(batch.column(c)[i].as_buffer(), np.float64).reshape(n, -1) for c in names]


def _packer(names: Sequence[str], rows: int, shards: bool):
    def block(parts: list[list[np.ndarray]], shard: int) -> pa.RecordBatch:
        whole = [np.concatenate(p) if len(p) > 1 else p[0] for p in zip(*parts, strict=True)]
        data = [pa.array([len(whole[0])], pa.int32()), pa.array([shard], pa.int64())]
        data += [pa.array([np.ascontiguousarray(m, np.float64).tobytes()], pa.binary()) for m in whole]
        return pa.RecordBatch.from_arrays(data, ["n", "shard", *names])

    def run(batches):
        parts, held, now = [], 0, 0
        for batch in batches:
            marks = batch.column("shard").to_numpy() if shards else np.zeros(batch.num_rows, np.int64)
            values = [matrix(batch.column(c)) for c in names]
            cuts = [0, *(np.flatnonzero(np.diff(marks)) + 1).tolist(), batch.num_rows]
            for a, b in zip(cuts, cuts[1:]):
                while a < b:
                    if held and (marks[a] != now or held == rows):
                        yield block(parts, now)
                        parts, held = [], 0
                    now, stop = int(marks[a]), min(b, a + rows - held)
                    parts.append([v[a:stop] for v in values])
                    held, a = held + stop - a, stop
        if held:
            yield block(parts, now)

    return run


def pack(df: DataFrame, columns: dict[str, Column], rows: int | None = None, shard: Sequence[Column] | None = None) -> DataFrame:
    """``n, shard`` and one binary column per entry of ``columns`` (vectors), written out.

    Without ``shard`` rows are packed as they are read, without a shuffle. ``shard`` is a
    number of the shard and an order inside it: blocks then hold rows of one shard in that
    order, so that they depend on the rows alone. Rows with a null vector are left out.
    """
    ship_package(df.sparkSession)
    vectors = [c.cast("array<double>").alias(name) for name, c in columns.items()]
    read = df.select(*vectors, *([shard[0].cast("long").alias("shard"), shard[1].alias("place")] if shard else []))
    for name in columns:
        read = read.where(F.col(name).isNotNull())
    if rows is None:
        first = read.select([F.size(c).alias(c) for c in columns]).first()
        width = max(1, sum(first)) if first else 1
        rows = max(1, BLOCK_BYTES // (8 * width))
    if shard:
        read = read.repartition("shard").sortWithinPartitions("shard", "place").drop("place")
    schema = "n int, shard long, " + ", ".join(f"{c} binary" for c in columns)
    return materialize(read.mapInArrow(_packer(list(columns), rows, bool(shard)), schema), "blocks")


def add_up(parts: DataFrame, tasks: int, key: str, value: str, size: int) -> list[tuple[int, np.ndarray]]:
    """Sums of the float64 vectors ``value`` (binary, ``size`` bytes) per ``key``.

    ``parts`` has up to one row per task and key. Few small rows are added on the driver;
    else they are added on the executors, about the square root of the tasks in a group,
    then the groups of a key, and the driver gets one row per key.
    """
    keys = {}
    if tasks > DIRECT_ROWS or tasks * size > DIRECT_BYTES:
        groups = max(1, int(np.ceil(np.sqrt(tasks))))

        def merged(table: pa.Table) -> pa.Table:
            total = sum(np.frombuffer(b, np.float64) for b in table.column(value).to_pylist())
            return pa.table({key: table.column(key)[:1], value: pa.array([total.tobytes()], pa.binary())})

        schema = f"{key} int, {value} binary"
        lane = F.pmod(F.spark_partition_id(), F.lit(groups)).alias("lane")
        parts = parts.groupBy(key, lane).applyInArrow(merged, schema).groupBy(key).applyInArrow(merged, schema)
    for row in parts.collect():
        v = np.frombuffer(row[value], np.float64)
        keys[row[key]] = keys[row[key]] + v if row[key] in keys else v
    return sorted(keys.items())
