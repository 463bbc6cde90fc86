"""Vectors of whole numbers, and sums of fixed size over all rows."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

SUMS = "key long, part long, total binary"


def lattice(vectors: pa.Array, scale: int, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the vectors to keep, and floor(scale * component) of these, one row each.

    A vector that is null or empty, or holds a null or a component that is not finite, is left out.
    """
    present = np.flatnonzero(vectors.is_valid().to_numpy(zero_copy_only=False))
    held = vectors.drop_null()
    sizes = pc.list_value_length(held).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = held.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)  # null components become NaN
    bad = np.concatenate(([0], np.cumsum(~np.isfinite(flat))))
    bounds = np.concatenate(([0], np.cumsum(sizes)))
    good = (sizes > 0) & (bad[bounds[1:]] == bad[bounds[:-1]])
    widths = np.unique(sizes[good])
    if len(widths) > 1:
        raise ValueError(f"vectors of several widths: {widths.tolist()}")
    x = np.floor(flat[np.repeat(good, sizes)] * scale)
    if len(x) and np.abs(x).max() > limit:
        raise ValueError(f"a component times {scale} is beyond {limit}")
    return present[good], x.astype(np.int64).reshape(-1, int(widths[0]) if len(widths) else 1)


def quantised(rows: DataFrame, vector: str, scale: int, limit: int) -> DataFrame:
    """The rows with a vector of finite components: their other columns, and ``x array<long>``."""
    keep = [name for name in rows.columns if name != vector]
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != vector)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            places, x = lattice(batch.column(vector), scale, limit)
            columns = [batch.column(name).take(pa.array(places)) for name in keep]
            yield pa.RecordBatch.from_arrays([*columns, as_lists(x)], [*keep, "x"])

    return rows.select(*keep, vector).mapInArrow(run, f"{kinds}{', ' * bool(keep)}x array<long>")


def as_lists(x: np.ndarray) -> pa.ListArray:
    """The rows of a matrix as lists."""
    offsets = np.arange(len(x) + 1, dtype=np.int32) * (x.shape[1] if len(x) else 0)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(x.reshape(-1)))


def as_matrix(lists: pa.Array) -> np.ndarray:
    """Lists of one width, none null, as the rows of a matrix."""
    sizes = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
    if len(sizes) and (sizes != sizes[0]).any():
        raise ValueError("vectors of several widths")
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(len(lists), -1 if len(lists) else 1)


def totals(totals_by_key: dict[int, np.ndarray]) -> pa.RecordBatch:
    """A task's sums as rows of SUMS."""
    part = TaskContext.get().partitionId() if TaskContext.get() else 0
    keys = sorted(totals_by_key)
    return pa.RecordBatch.from_arrays(
        [
            pa.array(keys, pa.int64()), pa.array([part] * len(keys), pa.int64()),
            pa.array([totals_by_key[k].tobytes() for k in keys], pa.binary()),
        ],
        ["key", "part", "total"],
    )


def added(parts: DataFrame, dtype: type, tasks: int) -> dict[int, np.ndarray]:
    """Rows of SUMS added up by key and brought to the driver: as many keys as the caller has.

    Added in two steps, so no task meets more than about the root of the number of tasks.
    """

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, total = None, None
        for batch in batches:
            for key, part, values in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if (key, part) != now:
                    if now is not None:
                        yield row(now, total)
                    now, total = (key, part), np.zeros(len(values) // 8, dtype)
                total += np.frombuffer(values, dtype)
        if now is not None:
            yield row(now, total)

    def row(at: tuple[int, int], total: np.ndarray) -> pa.RecordBatch:
        columns = [pa.array([at[0]], pa.int64()), pa.array([at[1]], pa.int64()), pa.array([total.tobytes()], pa.binary())]
        return pa.RecordBatch.from_arrays(columns, ["key", "part", "total"])

    def step(some: DataFrame) -> DataFrame:
        return some.repartition("key", "part").sortWithinPartitions("key", "part").mapInArrow(add, SUMS)

    salts = max(1, math.isqrt(max(tasks, 1)))
    once = step(parts.withColumn("part", F.col("part") % salts))
    found = step(once.withColumn("part", F.lit(0).cast("long"))).collect()
    return {row["key"]: np.frombuffer(bytes(row["total"]), dtype) for row in found}
