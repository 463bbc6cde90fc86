"""Dense count tables of fixed size: each task counts into its own, Spark adds them up by blocks."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

BLOCK = 1 << 13  # entries in a row
SCHEMA = "block long, part long, counts binary"


def _packed(counts: np.ndarray) -> bytes:
    return pa.compress(counts.tobytes(), codec="zstd", asbytes=True)


def _unpacked(counts: bytes) -> np.ndarray:
    return np.frombuffer(pa.decompress(counts, 4 * BLOCK, codec="zstd", asbytes=True), np.uint32)


def rows(counts: np.ndarray) -> Iterator[pa.RecordBatch]:
    """A task's table as rows of one block each, without blocks that are all zero."""
    part = TaskContext.get().partitionId() if TaskContext.get() else 0
    blocks = counts.astype(np.uint32, copy=False).reshape(-1, BLOCK)
    for block in np.flatnonzero(blocks.any(1)).tolist():
        yield pa.RecordBatch.from_arrays(
            [pa.array([block], pa.int64()), pa.array([part], pa.int64()), pa.array([_packed(blocks[block])], pa.binary())],
            ["block", "part", "counts"],
        )


def _added(parts: DataFrame, *keys: str) -> DataFrame:
    """One row per block and key, summed as the rows stream by."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, total = None, None

        def out() -> pa.RecordBatch:
            counts = _packed(np.minimum(total, np.iinfo(np.uint32).max).astype(np.uint32))
            return pa.RecordBatch.from_arrays(
                [pa.array([now[0]], pa.int64()), pa.array([now[1]], pa.int64()), pa.array([counts], pa.binary())],
                ["block", "part", "counts"],
            )

        for batch in batches:
            for block, part, counts in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if (block, part) != now:
                    if now is not None:
                        yield out()
                    now, total = (block, part), np.zeros(BLOCK, np.uint64)
                total += _unpacked(counts)
        if now is not None:
            yield out()

    return parts.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(add, SCHEMA)


def summed(parts: DataFrame, tasks: int, entries: int) -> np.ndarray:
    """The sum of all tasks' tables on the driver: ``entries`` counts, whatever the input's size.

    Added up in two steps, so that no task meets more than about the root of the number of tables.
    """
    salts = max(1, math.isqrt(max(tasks, 1)))
    once = _added(parts.withColumn("part", F.col("part") % salts), "block", "part")
    total = np.zeros(entries, np.uint32)
    for row in _added(once.withColumn("part", F.lit(0).cast("long")), "block", "part").toLocalIterator():
        total[row["block"] * BLOCK : (row["block"] + 1) * BLOCK] = _unpacked(row["counts"])
    return total
