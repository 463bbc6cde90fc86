"""Mergeable quantiles: sketches kept per group and merged over any set of groups.

The exact path (:mod:`plaudit.operators.distribution`) reads all values for every question. A sketch is a few
kilobytes per group, made once; the sketches of companies, days or batches add up to those of sectors or
months without the reviews. While a merged sketch holds no more values than its size its quantiles are exact.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

# Of 8 to 65,535: the rank error is about 2.3 / K, so 0.001 here, and the sketch of a large group takes about 20 KB.
K = 2000


def quantile_sketches(rows: DataFrame, keys: Sequence[str], value: str, k: int = K) -> DataFrame:
    """``keys, n, sketch, lowest, highest``: one row per group; null values are left out, null keys are a group.

    Sketches are made by every task and merged, so a company with a third of all reviews sends one a task.
    """
    column = F.col(value).cast("double")
    return rows.where(column.isNotNull()).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.kll_sketch_agg_double(column, F.lit(k)).alias("sketch"),
        F.min(column).alias("lowest"), F.max(column).alias("highest"),
    )


def merge_sketches(sketches: DataFrame, keys: Sequence[str], k: int = K) -> DataFrame:
    """The same of coarser groups: ``keys`` of those the sketches have. Sketches of several tables may be stacked first."""
    return sketches.groupBy(*keys).agg(
        F.sum("n").alias("n"), F.kll_merge_agg_double("sketch", F.lit(k)).alias("sketch"),
        F.min("lowest").alias("lowest"), F.max("highest").alias("highest"),
    )


def sketched_quantiles(sketches: DataFrame, points: Mapping[str, float]) -> DataFrame:
    """Adds a column for each point: a value whose rank is the point's, within the sketch's error; 0 and 1 are exact."""

    def at(p: float) -> Column:
        if p <= 0:
            return F.col("lowest")
        if p >= 1:
            return F.col("highest")
        return F.kll_sketch_get_quantile_double("sketch", F.lit(float(p)))

    return sketches.withColumns({name: at(p) for name, p in points.items()}).drop("sketch")


def sketched_rank(sketches: DataFrame, value: Column) -> Column:
    """The share of a group's values that are no more than ``value``."""
    return F.kll_sketch_get_rank_double("sketch", value.cast("double"))
