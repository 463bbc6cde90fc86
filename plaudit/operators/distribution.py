"""Exact ranks, quantiles, box statistics and histograms without a single-task sort.

Rows are first reduced to one row per distinct value. Ranks are then running sums in two
levels: inside a value bucket, and over the bucket totals. No window ever holds more than the
distinct values of one bucket, or one row per bucket, however many rows share a group.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window, functions as F

BUCKETS = 4096
# Steps of the logarithmic parts of a bucket's place: as fine as doubles resolve a range.
_STEPS = 1e15


def frequencies(rows: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """One row per distinct non-null value in a group with non-null keys: ``keys, value, n``.

    Null keys are left out here rather than by the later joins: every branch of a plan then holds
    the same filters and shares this shuffle.
    """
    known = reduce(and_, (F.col(c).isNotNull() for c in dict.fromkeys([*keys, value])))
    return (
        rows.where(known)
        .groupBy(*keys, value)
        .agg(F.count(F.lit(1)).alias("n"))
    )


def ranked(
    values: DataFrame,
    keys: Sequence[str],
    value: str,
    first: Sequence[Column] = (),
    buckets: int = BUCKETS,
) -> DataFrame:
    """Add ``below``, the rows strictly smaller, and ``total``, all rows of the group.

    ``first`` orders rows of equal value; a row counts those before it, so rows with ``n = 0``
    must come first. Each group's range of values is cut into so many ``buckets``, by the value and by
    the logarithms of its distances from both ends, so that neither even nor long-tailed values crowd into one.
    """
    keys = list(keys)
    before = (Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("long")
    # Values are never null here; saying so keeps the join from adding a null filter to one branch.
    ranges = values.groupBy(*keys).agg(
        F.min(value).cast("double").alias("lowest"), F.max(value).cast("double").alias("highest")
    )
    span = F.col("highest") - F.col("lowest")
    low, high = F.try_divide(F.col(value) - F.col("lowest"), span), F.try_divide(F.col("highest") - F.col(value), span)

    def log(share: Column) -> Column:
        return F.log1p(share * _STEPS) / F.log1p(F.lit(_STEPS))

    both = (low + log(low) + 1 - log(high)) / 3  # rises with the value
    place = F.coalesce(F.floor(both * buckets), zero)  # one value: one bucket
    values = (
        values.join(ranges, keys)
        .withColumn("bucket", F.least(place, F.lit(buckets - 1).cast("long")))
        .drop("lowest", "highest")
        .repartition(*keys, "bucket")  # serves both the totals and the ranks of a bucket
    )
    totals = values.groupBy(*keys, "bucket").agg(F.sum("n").alias("in_bucket"))
    over_buckets = Window.partitionBy(*keys)
    offsets = totals.select(
        *keys,
        "bucket",
        F.sum("in_bucket").over(over_buckets.orderBy("bucket").rowsBetween(*before)).alias("offset"),
        F.sum("in_bucket").over(over_buckets).alias("total"),
    )
    in_bucket = Window.partitionBy(*keys, "bucket").orderBy(value, *first).rowsBetween(*before)
    return (
        values.withColumn("smaller", F.sum("n").over(in_bucket))
        .join(offsets, [*keys, "bucket"])
        .withColumn("below", F.coalesce("offset", zero) + F.coalesce("smaller", zero))
        .drop("bucket", "smaller", "offset")
    )


def quantile_aggregates(value: str, points: Mapping[str, float]) -> list[Column]:
    """Aggregates over :func:`ranked` rows that pick the neighbours of each quantile."""
    columns = []
    for name, p in points.items():
        position = (F.col("total") - 1) * p
        for side, rank in (("lo", F.floor(position)), ("hi", F.ceil(position))):
            here = (F.col("below") <= rank) & (rank < F.col("below") + F.col("n"))
            columns.append(F.max(F.when(here, F.col(value))).alias(f"{name}_{side}"))
    return columns


def quantile_columns(points: Mapping[str, float], total: str = "total") -> dict[str, Column]:
    """Linear interpolation between the neighbours picked by :func:`quantile_aggregates`."""
    columns = {}
    for name, p in points.items():
        position = (F.col(total) - 1) * p
        low, high = F.col(f"{name}_lo"), F.col(f"{name}_hi")
        columns[name] = low + (high - low) * (position - F.floor(position))
    return columns


def quantiles(
    values: DataFrame, keys: Sequence[str], value: str, points: Mapping[str, float]
) -> DataFrame:
    """Exact interpolated quantiles of :func:`ranked` rows: ``keys, total, <points>``."""
    picked = values.groupBy(*keys).agg(
        F.max("total").alias("total"), *quantile_aggregates(value, points)
    )
    return picked.select(
        *keys, "total", *(c.alias(name) for name, c in quantile_columns(points).items())
    )


BOX_POINTS = {"q1": 0.25, "median": 0.5, "q3": 0.75}


def with_whiskers(
    boxes: DataFrame, values: DataFrame, keys: Sequence[str], value: str
) -> DataFrame:
    """Add whiskers (extremes within 1.5 IQR of the box) and the number of outliers.

    ``values`` are the distinct values with their count ``n``.
    """
    reach = 1.5 * (F.col("q3") - F.col("q1"))
    v, n = F.col(value), F.col("n")
    low, high = v >= F.col("q1") - reach, v <= F.col("q3") + reach
    whiskers = (
        values.where(n > 0)
        .join(boxes.select(*keys, "q1", "q3"), list(keys))
        .groupBy(*keys)
        .agg(
            F.least(F.min(F.when(low, v)), F.max("q1")).alias("whisker_low"),
            F.greatest(F.max(F.when(high, v)), F.max("q3")).alias("whisker_high"),
            F.sum(F.when(low & high, F.lit(0)).otherwise(n)).alias("n_outliers"),
        )
    )
    return boxes.join(whiskers, list(keys))


def box_statistics(rows: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """``keys, n, q1, median, q3, whisker_low, whisker_high, n_outliers`` per group."""
    values = frequencies(rows, keys, value)
    ranks = ranked(values, keys, value)
    boxes = quantiles(ranks, keys, value, BOX_POINTS).withColumnRenamed("total", "n")
    return with_whiskers(boxes, values, keys, value)


def histogram(rows: DataFrame, keys: Sequence[str], value: str, bins: int) -> DataFrame:
    """Equal-width bins over each group's own range, last bin closed, empty bins included.

    A group with one distinct value gets a range of one unit around it.
    """
    keys = list(keys)
    values = frequencies(rows, keys, value)
    v = F.col(value)
    ranges = values.groupBy(*keys).agg(
        F.min(v).cast("double").alias("low"),
        F.max(v).cast("double").alias("high"),
        F.sum("n").alias("total"),
    )
    constant = F.col("low") == F.col("high")
    ranges = ranges.select(
        *keys,
        F.when(constant, F.col("low") - 0.5).otherwise(F.col("low")).alias("low"),
        F.when(constant, F.col("high") + 0.5).otherwise(F.col("high")).alias("high"),
        "total",
    )
    low, high = F.col("low"), F.col("high")
    step = (high - low) / bins

    def edge(i: Column) -> Column:
        return F.when(i == bins, high).otherwise(i * step + low)

    guess = F.least(F.floor((v - low) * (bins / (high - low))), F.lit(bins - 1).cast("long"))
    # The guess may be off by one at an edge; the edges decide.
    placed = (
        values.join(ranges, keys)
        .withColumn("bin", guess)
        .withColumn("bin", F.when(v < edge(F.col("bin")), F.col("bin") - 1).otherwise(F.col("bin")))
        .withColumn(
            "bin",
            F.when((v >= edge(F.col("bin") + 1)) & (F.col("bin") < bins - 1), F.col("bin") + 1)
            .otherwise(F.col("bin")),
        )
        # The total is a key so that both uses of the ranges stay the same aggregation: without a
        # count, Spark would take the extremes from the rows again.
        .groupBy(*keys, "bin", "total")
        .agg(F.sum("n").alias("n"))
        .drop("total")
    )
    grid = ranges.select(
        *keys, "low", "high", "total",
        F.explode(F.sequence(F.lit(0).cast("long"), F.lit(bins - 1).cast("long"))).alias("bin"),
    )
    start, end = edge(F.col("bin")), edge(F.col("bin") + 1)
    n = F.coalesce("n", F.lit(0).cast("long"))
    return grid.join(placed, [*keys, "bin"], "left").select(
        *keys,
        "bin",
        start.alias("bin_start"),
        end.alias("bin_end"),
        n.alias("n"),
        (n / (F.col("total") * (end - start))).alias("density"),
    )


def shares(
    rows: DataFrame, keys: Sequence[str], value: str, name: str = "n"
) -> DataFrame:
    """Rows per distinct value and their share of the group's non-null rows, in percent."""
    counted = frequencies(rows, keys, value).withColumnRenamed("n", name)
    total = F.sum(name).over(Window.partitionBy(*keys))
    return counted.withColumn("pct", F.col(name) / total * 100)
