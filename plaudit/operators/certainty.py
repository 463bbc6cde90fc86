"""How certain gaps are: a Poisson bootstrap of all topics in one pass.

In every replicate each review counts 0, 1, 2, ... times, drawn from a Poisson distribution of mean 1
by a hash of review id and replicate. So no row is moved or drawn twice, every task can tell a review's
weight by itself, and a second run gives the same bounds. What Spark shuffles is one row per task,
side, topic and replicate.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from plaudit.constants import OTHER_TOPIC, WEAK_GAP

REPLICATES = 200
LEVEL = 0.95
# Fixed values of the hash: a prime modulus below 2**31, so products fit a long, and multipliers.
MODULUS = 2147483647
MULTIPLIERS = (48271, 1566083941, 630360016)
# Weights from here on are drawn less than once in 10**9.
MOST = 12


def poisson_thresholds(most: int = MOST) -> list[int]:
    """Of hashes below MODULUS: from the k-th on the weight is more than k."""
    total, out = 0.0, []
    for k in range(most):
        total += math.exp(-1) / math.factorial(k)
        out.append(math.floor(total * MODULUS))
    return out


def hashed(review_id: Column, replicate: Column) -> Column:
    """A number from 0 to MODULUS - 1 for every review and replicate; a null id counts as -1."""
    x = F.pmod(F.coalesce(review_id.cast("long"), F.lit(-1).cast("long")), F.lit(MODULUS).cast("long"))
    x = F.pmod(x * MULTIPLIERS[0] + replicate.cast("long") * MULTIPLIERS[2] + 1, F.lit(MODULUS).cast("long"))
    for shift in (13, 17):
        x = x.bitwiseXOR(F.shiftright(x, shift))
        x = F.pmod(x * MULTIPLIERS[1], F.lit(MODULUS).cast("long"))
    return F.pmod(x.bitwiseXOR(F.shiftright(x, 15)), F.lit(MODULUS).cast("long"))


def poisson_weight(hash_: Column) -> Column:
    """The review's weight in the replicate."""
    return sum(((hash_ >= t).cast("int") for t in poisson_thresholds()), F.lit(0))


def replicate_gaps(assembled: DataFrame, replicates: int = REPLICATES) -> DataFrame:
    """``macro_topic, replicate, gap`` of the named topics; a replicate without rows of a side has none."""
    if replicates < 1:
        raise ValueError("replicates must be 1 or more")
    named = assembled.where(F.col("macro_topic") != OTHER_TOPIC).select(
        "review_id", "is_target", "macro_topic",
        F.when(F.col("sentiment") == "positive", 1).when(F.col("sentiment") == "negative", -1).otherwise(0).alias("sign"),
    )
    drawn = named.select("*", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))).alias("replicate"))
    # The hash is long; a projection of its own keeps it from being written out once a threshold.
    weighed = drawn.withColumn("h", hashed(F.col("review_id"), F.col("replicate"))).withColumn("w", poisson_weight(F.col("h")))
    sides = weighed.groupBy("macro_topic", "replicate").agg(
        *(F.sum(F.when(F.col("is_target") == side, F.col("w"))).alias(f"n_{name}") for name, side in (("target", True), ("comp", False))),
        *(F.sum(F.when(F.col("is_target") == side, F.col("w") * F.col("sign"))).alias(f"s_{name}") for name, side in (("target", True), ("comp", False))),
    )
    net = {name: F.try_divide(F.col(f"s_{name}") * F.lit(100.0), F.col(f"n_{name}")) for name in ("target", "comp")}
    return sides.select("macro_topic", "replicate", (net["target"] - net["comp"]).alias("gap")).where("gap is not null")


def gap_bounds(
    assembled: DataFrame, merged: DataFrame, replicates: int = REPLICATES, level: float = LEVEL
) -> DataFrame:
    """The rows of ``merged`` (head to head) with bounds of the gap.

    ``gap_low`` and ``gap_high`` are the outer quantiles of the replicates, interpolated; ``share_below``
    is the share of replicates with a gap below 0; ``n_replicates`` how many there are. A topic with at
    most ``replicates`` rows here is one group, whatever the number of reviews.
    """
    if not 0 < level < 1:
        raise ValueError("level must lie between 0 and 1")
    gaps = replicate_gaps(assembled, replicates)
    topic = Window.partitionBy("macro_topic")
    placed = gaps.withColumns({
        "place": F.row_number().over(topic.orderBy("gap", "replicate")) - 1, "count": F.count(F.lit(1)).over(topic),
    })

    def point(p: float) -> Column:
        position = (F.col("count") - 1) * F.lit(p)
        low = F.max(F.when(F.col("place") == F.floor(position), F.col("gap")))
        high = F.max(F.when(F.col("place") == F.ceil(position), F.col("gap")))
        return low + (high - low) * F.max(position - F.floor(position))

    bounds = placed.groupBy("macro_topic").agg(
        point((1 - level) / 2).alias("gap_low"), point((1 + level) / 2).alias("gap_high"),
        F.avg((F.col("gap") < 0).cast("double")).alias("share_below"), F.count(F.lit(1)).alias("n_replicates"),
    )
    return merged.join(bounds, "macro_topic", "left")


def certainly_weak(bounded: DataFrame, min_gap: float = WEAK_GAP) -> DataFrame:
    """Topics whose whole interval lies below ``min_gap``; stands in for a floor on the number of reviews."""
    return bounded.where(F.col("gap_high") < min_gap)


def certain_strengths_weaknesses(bounded: DataFrame) -> DataFrame:
    """``list`` of each topic: strength if all of the interval is above 0, weakness if below, else undecided."""
    low, high = F.col("gap_low"), F.col("gap_high")
    kind = F.when(low > 0, "strength").when(high < 0, "weakness").otherwise("undecided")
    return bounded.select(kind.alias("list"), "macro_topic", "gap", "gap_low", "gap_high", "share_below")
