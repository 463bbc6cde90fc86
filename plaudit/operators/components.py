"""Connected components by contraction in random order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from plaudit.plans.session import durable, durable_files, remove_durable


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node, root``: for every node of an edge, the smallest node it is connected with.

    In each round every node joins the neighbour that comes first in an order drawn for the round, if
    that comes before itself, and edges then connect what they have joined. About the logarithm of the
    longest path in rounds; each is written, so a lost executor costs one round. A hub's edges are
    reduced to one row per task before they meet. Null nodes and loops connect nothing.
    """
    spark = edges.sparkSession
    left = durable(_clean(edges.select(F.col(a).alias("a"), F.col(b).alias("b"))), "contraction-edges")
    joined: list[DataFrame] = []
    while not left.isEmpty():

        def place(node: str) -> Column:
            return F.struct(F.xxhash64(node, F.lit(len(joined))).alias("place"), F.col(node).alias("node"))

        both = left.unionByName(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        first = both.groupBy("a").agg(F.min(place("b")).alias("first"))
        parents = durable(
            first.select(F.col("a").alias("node"), F.least("first", place("a"))["node"].alias("parent")), "contraction"
        )
        moved = left.join(parents.select(F.col("node").alias("a"), F.col("parent").alias("pa")), "a").join(
            parents.select(F.col("node").alias("b"), F.col("parent").alias("pb")), "b"
        )
        before, left = left, durable(_clean(moved.select(F.col("pa").alias("a"), F.col("pb").alias("b"))), "contraction-edges")
        _drop(before)
        joined.append(parents)
    if not joined:
        return spark.createDataFrame([], "node long, root long")
    found = joined[-1]
    for parents in reversed(joined[:-1]):  # where a node went in a round, and where that went in later ones
        later = found.select(F.col("node").alias("parent"), F.col("parent").alias("_later"))
        found = parents.join(later, "parent", "left").select("node", F.coalesce("_later", "parent").alias("parent"))
    least = found.groupBy("parent").agg(F.min("node").alias("root"))
    out = durable(found.join(least, "parent").select("node", "root"), "components")
    for table in [left, *joined]:
        _drop(table)
    return out


def _clean(edges: DataFrame) -> DataFrame:
    a, b = F.least("a", "b"), F.greatest("a", "b")
    return edges.where(F.col("a") != F.col("b")).select(a.alias("a"), b.alias("b")).distinct()


def _drop(table: DataFrame) -> None:
    for path in durable_files(table):
        remove_durable(table.sparkSession, path)
