"""Density clusters of review vectors: a neighbour graph, core distances, mutual reachability.

Vectors are compared by direction: distances are those of vectors of length 1, from 0 to 2. Equal
vectors are one node with a weight, so a text that a third of all reviews share is one row.

Neighbours come from buckets: random hyperplanes give every vector a code per table, rows are dealt
by range of the code, and runs of ``BUCKET`` neighbouring codes are compared all with all in one task.
Runs are of one size whatever the data, so no direction fills a task; several tables, each with
hyperplanes of its own, make up for the cuts between runs. Up to ``BUCKET`` vectors the graph is exact.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from plaudit.functions.vectors import is_finite_vector
from plaudit.operators.components import components
from plaudit.operators.distribution import quantiles, ranked
from plaudit.plans.session import durable, durable_files, remove_durable, ship_package

BUCKET = 2048
TABLES = 8
BITS = 32
SEED = 42
MIN_SAMPLES = 10
MIN_CLUSTER_SIZE = 60
CORE_SHARE = 0.5
# Buckets that a task holds; candidates kept beyond the k nearest before distances are exact.
_RUN = 16
_SPARE = 16
_NEAR = "near array<struct<distance:double,other:long,copies:long>>"


def distinct_vectors(reviews: DataFrame, embedding: str = "embedding") -> DataFrame:
    """``node`` (the smallest review id of a vector), ``copies``, ``vector``; finite vectors only."""
    return (
        reviews.where(is_finite_vector(F.col(embedding)))
        .groupBy(F.col(embedding).cast("array<double>").alias("vector"))
        .agg(F.min("review_id").alias("node"), F.count(F.lit(1)).alias("copies"))
        .where(F.col("node").isNotNull())
        .select("node", "copies", "vector")
    )


def _matrix(vectors: pa.ChunkedArray) -> np.ndarray:
    """Lists as rows of length 1; a zero vector stays."""
    held = vectors.combine_chunks()
    flat = held.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    if len(held) and flat.size % len(held):
        raise ValueError("vectors of several widths")
    x = flat.reshape(len(held), -1)
    length = np.linalg.norm(x, axis=1)
    return x / np.where(length == 0, 1.0, length)[:, None]


def _in_buckets(
    nodes: DataFrame, tables: int, seed: int, schema: str, compare: Callable[[np.ndarray, np.ndarray, np.ndarray], pa.RecordBatch]
) -> DataFrame:
    """``compare(nodes, copies, matrix)`` of every bucket of every table.

    ``nodes`` is read twice, once for its size; pass a table that is written.
    """

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes = None
        for batch in batches:
            x = _matrix(pa.chunked_array([batch.column("vector")]))
            if not len(x):
                continue
            if planes is None:
                planes = [np.random.default_rng([seed, t]).normal(size=(x.shape[1], BITS)) for t in range(tables)]
            for t in range(tables):
                codes = ((x @ planes[t]) > 0) @ (1 << np.arange(BITS, dtype=np.int64))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(x), t, np.int32)), pa.array(codes), *batch.columns], ["table", "code", *batch.schema.names]
                )

    def bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = pa.Table.from_batches(list(batches), schema=coded_schema)
        if not held.num_rows:
            return
        of = held.column("table").to_numpy()
        cuts = [0, *(np.flatnonzero(of[1:] != of[:-1]) + 1).tolist(), len(of)]
        for first, last in zip(cuts, cuts[1:]):
            for start in range(first, last, BUCKET):
                stop = min(start + BUCKET, last)
                some = held.slice(max(first, stop - BUCKET), stop - max(first, stop - BUCKET))  # the last run is full too
                yield compare(some.column("node").to_numpy(), some.column("copies").to_numpy(), _matrix(some.column("vector")))

    coded = nodes.select("node", "copies", "vector").mapInArrow(
        code, "table int, code long, node long, copies long, vector array<double>"
    )
    coded_schema = pa.schema([
        ("table", pa.int32()), ("code", pa.int64()), ("node", pa.int64()), ("copies", pa.int64()), ("vector", pa.list_(pa.float64())),
    ])
    parts = max(1, math.ceil(nodes.count() * tables / (BUCKET * _RUN)))
    order = ["table", "code", "node"]
    return coded.repartitionByRange(parts, *order).sortWithinPartitions(*order).mapInArrow(bucket, schema)


def _squares(x: np.ndarray) -> np.ndarray:
    """Squared distances of all rows, up to rounding."""
    size = (x * x).sum(1)
    return size[:, None] + size[None, :] - 2 * (x @ x.T)


def _exact(x: np.ndarray, rows: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Distances of pairs, each summed in the same order wherever the pair is met."""
    out = np.empty(len(rows))
    for start in range(0, len(rows), 1 << 15):
        some = slice(start, start + (1 << 15))
        out[some] = np.sqrt(((x[rows[some]] - x[others[some]]) ** 2).sum(1))
    return out


def neighbour_graph(nodes: DataFrame, k: int = MIN_SAMPLES, tables: int = TABLES, seed: int = SEED) -> DataFrame:
    """``node, copies, near``: up to ``k`` nearest other nodes with distance and copies, nearest first.

    Of equal distances the smaller node comes first. ``nodes`` as from :func:`distinct_vectors`, written.
    """
    if k < 1:
        raise ValueError("k must be 1 or more")
    ship_package(nodes.sparkSession)

    def compare(ids: np.ndarray, copies: np.ndarray, x: np.ndarray) -> pa.RecordBatch:
        m = len(ids)
        take = min(k + _SPARE, m - 1)
        near = _squares(x)
        near[np.arange(m), np.arange(m)] = np.inf
        others = np.argpartition(near, take - 1, axis=1)[:, :take] if take else np.zeros((m, 0), np.int64)
        distance = _exact(x, np.repeat(np.arange(m), take), others.reshape(-1)).reshape(m, take)
        order = np.lexsort((ids[others], distance))[:, :k]
        others, distance = np.take_along_axis(others, order, 1), np.take_along_axis(distance, order, 1)
        width = others.shape[1]
        pairs = pa.StructArray.from_arrays(
            [pa.array(distance.reshape(-1)), pa.array(ids[others].reshape(-1)), pa.array(copies[others].reshape(-1))],
            ["distance", "other", "copies"],
        )
        lists = pa.ListArray.from_arrays(pa.array(np.arange(m + 1, dtype=np.int32) * width), pairs)
        return pa.RecordBatch.from_arrays([pa.array(ids), pa.array(copies), lists], ["node", "copies", "near"])

    met = _in_buckets(nodes, tables, seed, f"node long, copies long, {_NEAR}", compare)
    return met.groupBy("node").agg(
        F.max("copies").alias("copies"),
        F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("near")))), 1, k).alias("near"),  # of each table k
    )


def with_core_distance(graph: DataFrame, min_samples: int = MIN_SAMPLES) -> DataFrame:
    """Adds ``core_distance``: the radius around a review that holds ``min_samples`` other reviews.

    Copies count; null where the graph has fewer.
    """
    needed = F.lit(min_samples).cast("long") - (F.col("copies") - 1)
    start = F.struct(F.lit(0).cast("long").alias("seen"), F.lit(None).cast("double").alias("core"))

    def add(so_far, near):
        seen = so_far["seen"] + near["copies"]
        return F.struct(seen.alias("seen"), F.coalesce(so_far["core"], F.when(seen >= needed, near["distance"])).alias("core"))

    reached = F.aggregate("near", start, add)["core"]
    return graph.withColumn("core_distance", F.when(needed <= 0, F.lit(0.0)).otherwise(reached))


def core_radius(cores: DataFrame, share: float = CORE_SHARE) -> float | None:
    """The core distance that ``share`` of the reviews with one do not exceed, interpolated; exact."""
    # One group; its values are ranked in buckets, and only the picked value comes to the driver.
    values = cores.where("core_distance is not null").groupBy(F.lit(0).alias("all"), "core_distance").agg(F.sum("copies").alias("n"))
    found = quantiles(ranked(values, ["all"], "core_distance"), ["all"], "core_distance", {"radius": share}).first()
    return None if found is None else found["radius"]


def dense_components(dense: DataFrame, radius: float, tables: int = TABLES, seed: int = SEED) -> DataFrame:
    """``node, root`` of the nodes with a neighbour within ``radius``; all of ``dense`` are cores.

    Every bucket hands on a spanning forest of its pairs within the radius, never the pairs.
    """

    def compare(ids: np.ndarray, copies: np.ndarray, x: np.ndarray) -> pa.RecordBatch:
        squares = _squares(x)
        close = squares <= radius * radius
        rows, others = np.nonzero(np.abs(squares - radius * radius) < 1e-9)  # where rounding might decide
        close[rows, others] = _exact(x, rows, others) <= radius
        label = np.arange(len(ids))
        big = len(ids)
        while True:  # the least label around, then that label's own
            least = np.minimum(label, np.where(close, label[None, :], big).min(1, initial=big))
            np.minimum.at(least, label, least.copy())
            least = least[least]
            if (least == label).all():
                break
            label = least
        tree = np.flatnonzero(label != np.arange(len(ids)))
        return pa.RecordBatch.from_arrays([pa.array(ids[tree]), pa.array(ids[label[tree]])], ["a", "b"])

    return components(_in_buckets(dense, tables, seed, "a long, b long", compare))


def density_clusters(
    reviews: DataFrame,
    min_samples: int = MIN_SAMPLES,
    min_cluster_size: int = MIN_CLUSTER_SIZE,
    radius: float | None = None,
    core_share: float = CORE_SHARE,
    tables: int = TABLES,
    seed: int = SEED,
    embedding: str = "embedding",
) -> DataFrame:
    """``review_id, core_distance, cluster, cluster_size`` of every review.

    Two reviews are linked when each has ``min_samples`` others within ``radius`` and they lie within it
    of each other (their mutual reachability is no more). Linked reviews are a cluster, named by its
    smallest review id, if there are ``min_cluster_size`` of them; all others are noise, with null. Without a
    ``radius`` it is the core distance that ``core_share`` of the reviews keep within. Reviews without a
    finite vector have no core distance and no cluster.
    """
    spark = reviews.sparkSession
    ship_package(spark)
    nodes = durable(distinct_vectors(reviews, embedding), "density-nodes")
    cores = durable(
        with_core_distance(neighbour_graph(nodes, min_samples, tables, seed), min_samples).drop("near"), "density-cores"
    )
    if radius is None:
        radius = core_radius(cores, core_share)
    dense = durable(
        nodes.join(cores.where(F.col("core_distance") <= F.lit(radius)).select("node"), "node", "left_semi"), "density-dense"
    )
    roots = dense_components(dense, radius, tables, seed) if radius is not None else spark.createDataFrame([], "node long, root long")
    member = (
        dense.select("node", "copies").join(roots, "node", "left").select("node", "copies", F.coalesce("root", "node").alias("cluster"))
    )
    sizes = member.groupBy("cluster").agg(F.sum("copies").alias("cluster_size")).where(F.col("cluster_size") >= min_cluster_size)
    clustered = member.join(sizes, "cluster").select("node", "cluster", "cluster_size")
    of_node = nodes.select("node", F.col("vector").alias("_vector")).join(cores.select("node", "core_distance"), "node", "left").join(clustered, "node", "left")
    known = is_finite_vector(F.col(embedding))
    vector = F.when(known, F.col(embedding).cast("array<double>")).alias("_vector")
    out = durable(
        reviews.select("review_id", vector).join(of_node.drop("node"), "_vector", "left")
        .select("review_id", "core_distance", "cluster", "cluster_size"),
        "density-clusters",
    )
    for table in (nodes, cores, dense, roots):
        for path in durable_files(table):
            remove_durable(spark, path)
    return out
