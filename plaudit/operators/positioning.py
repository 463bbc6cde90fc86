"""Where one company stands among the others of its sector."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from plaudit.operators.companies import stacked
from plaudit.operators.distribution import (
    BOX_POINTS,
    frequencies,
    histogram,
    quantile_aggregates,
    quantile_columns,
    ranked,
    with_whiskers,
)

KPIS = ("pct_positive", "pct_negative", "avg_stars")
WORD_TIERS = ("wc_negative", "wc_neutral", "wc_positive")
SPLIT = ("pct_positive", "pct_neutral", "pct_negative")
_KEYS = ["category", "metric"]
_EVERYONE = "everyone"


def percentile_ranks(stats: DataFrame, metrics: Sequence[str] = KPIS) -> DataFrame:
    """Percentile of every company: share of the other companies strictly below it.

    Null for the only company of a sector. Companies are ranked through the distinct values of
    a metric, so a sector is never sorted in one task.
    """
    long = stacked(stats, metrics, ["category", "company"]).where(F.col("value").isNotNull())
    ranks = ranked(frequencies(long, _KEYS, "value"), _KEYS, "value")
    others = F.col("total") - 1
    return long.join(ranks, [*_KEYS, "value"]).select(
        "category",
        "company",
        "metric",
        "value",
        F.when(others > 0, F.col("below") / others * 100).alias("percentile"),
    )


def _values_around(long: DataFrame, target: str) -> DataFrame:
    """Distinct values of the competitors, and the target's own value with weight 0."""
    flagged = long.withColumn("is_target", F.col("company").eqNullSafe(target))
    # The flag is a key: every consumer then shares this one aggregation and its shuffle.
    values = flagged.where(F.col("value").isNotNull()).groupBy(*_KEYS, "value", "is_target").agg(
        F.count(F.lit(1)).alias("rows")
    )
    return values.select(
        *_KEYS, "value", "is_target",
        F.when(F.col("is_target"), F.lit(0)).otherwise(F.col("rows")).alias("n"),
    )


def _ranked_around(values: DataFrame) -> DataFrame:
    return ranked(values, _KEYS, "value", first=[F.desc("is_target")])


def _target_rows(values: DataFrame) -> DataFrame:
    """Per sector and metric: target value, percentile and box of the competitors."""
    values = _ranked_around(values)
    mine = F.col("is_target")
    found = values.groupBy(*_KEYS).agg(
        F.max(F.when(mine, F.col("value"))).alias("target_value"),
        F.max(F.when(mine, F.col("below"))).alias("target_below"),
        F.max("total").alias("total"),
        *quantile_aggregates("value", BOX_POINTS),
    )
    return found.where(F.col("target_value").isNotNull()).select(
        *_KEYS,
        "target_value",
        "target_below",
        F.col("total").alias("n_competitors"),
        F.when(F.col("total") > 0, F.col("target_below") / F.col("total") * 100).alias("percentile"),
        *(c.alias(name) for name, c in quantile_columns(BOX_POINTS).items()),
    )


def percentile_dashboard(
    stats: DataFrame, target: str, metrics: Sequence[str] = KPIS
) -> DataFrame:
    """Target value, competitor median and percentile for each key metric.

    Sectors without the target, and metrics it has no value for, give no row.
    """
    long = stacked(stats, metrics, ["category", "company"])
    return _target_rows(_values_around(long, target)).select(
        *_KEYS, "target_value", "median", "percentile", "n_competitors"
    )


def word_count_positioning(stats: DataFrame, target: str) -> DataFrame:
    """Target words per review in each tier against the box of the competitors."""
    values = _values_around(stacked(stats, WORD_TIERS, ["category", "company"]), target)
    boxes = _target_rows(values).drop("target_below")
    return with_whiskers(boxes, values, _KEYS, "value")


def stars_positioning(stats: DataFrame, target: str) -> DataFrame:
    """Target average stars, sector median and percentile among all other companies.

    Competitors without a rating count in the denominator here, but not in the median.
    """
    rated = stats.withColumn(_EVERYONE, F.lit(0.0))
    long = stacked(rated, ["avg_stars", _EVERYONE], ["category", "company"])
    rows = _target_rows(_values_around(long, target))
    stars, everyone = F.col("metric") == "avg_stars", F.col("metric") == _EVERYONE
    one = rows.groupBy("category").agg(
        F.max(F.when(stars, F.col("target_value"))).alias("target_value"),
        F.max(F.when(stars, F.col("median"))).alias("sector_median"),
        F.max(F.when(stars, F.col("target_below"))).alias("below"),
        F.max(F.when(everyone, F.col("n_competitors"))).alias("n_competitors"),
    )
    n = F.col("n_competitors")
    return one.where(F.col("target_value").isNotNull()).select(
        "category",
        "target_value",
        "sector_median",
        F.when(n > 0, F.col("below") / n * 100).alias("percentile"),
        "n_competitors",
    )


def stars_histogram(stats: DataFrame, target: str, bins: int = 10) -> DataFrame:
    """Density histogram of the competitors' average stars."""
    others = stats.where(~F.col("company").eqNullSafe(target))
    return histogram(others, ["category"], "avg_stars", bins)


def sentiment_split(stats: DataFrame, target: str) -> DataFrame:
    """Sentiment shares of the target, the sector median, the best and the worst competitor.

    Only sectors that hold the target. The first company by name wins a tie.
    """
    mine = F.col("company").eqNullSafe(target)
    rated = ~mine & F.col("avg_stars").isNotNull()
    row = F.struct("company", "avg_stars", *SPLIT)
    best = F.when(rated, F.struct((-F.col("avg_stars")).alias("s"), F.col("company").alias("c")))
    worst = F.when(rated, F.struct(F.col("avg_stars").alias("s"), F.col("company").alias("c")))
    picks = (
        stats.groupBy("category")
        .agg(
            F.max(F.when(mine, row)).alias("target"),
            F.min_by(row, best).alias("best"),
            F.min_by(row, worst).alias("worst"),
        )
        .where(F.col("target").isNotNull())
    )
    # All companies and the same four metrics as in the picks, so that both read one aggregation;
    # the target itself weighs nothing.
    long = stacked(stats, ["avg_stars", *SPLIT], ["category", "company"])
    points = {"median": 0.5}
    medians = (
        _ranked_around(_values_around(long, target))
        .groupBy(*_KEYS)
        .agg(F.max("total").alias("total"), *quantile_aggregates("value", points))
        .withColumns(quantile_columns(points))
        .groupBy("category")
        .agg(*(F.max(F.when(F.col("metric") == c, F.col("median"))).alias(c) for c in SPLIT))
    )
    median = F.struct(
        F.lit(None).cast("string").alias("company"),
        F.lit(None).cast("double").alias("avg_stars"),
        *SPLIT,
    )

    def line(order: int, position: str, label, fields):
        return F.struct(
            F.lit(order).alias("line"),
            F.lit(position).alias("position"),
            label.alias("label"),
            fields.alias("fields"),
        )

    def starred(name: str, row: str):
        return F.format_string(f"{name} (★ %.2f)", F.col(f"{row}.avg_stars"))

    lines = F.array(
        line(1, "target", F.lit(target), F.col("target")),
        line(2, "median", F.lit("Sector median"), median),
        line(3, "best", starred("Best", "best"), F.col("best")),
        line(4, "worst", starred("Worst", "worst"), F.col("worst")),
    )
    return (
        picks.join(medians, "category", "left")
        .select("category", F.inline(lines))
        .select("category", "line", "position", "label", "fields.*")
    )


def star_density(
    stats: DataFrame, target: str | None = None, grid_points: int = 200, cut: float = 3.0
) -> DataFrame:
    """Gaussian kernel density of average stars per sector (Scott's bandwidth).

    The grid spans ``cut`` bandwidths beyond the data. Distinct values are weighted by their
    count, and each value meets the fixed grid of its own sector only.
    """
    rows = stats if target is None else stats.where(~F.col("company").eqNullSafe(target))
    values = frequencies(rows, ["category"], "avg_stars")
    shape = (
        rows.groupBy("category")
        .agg(
            F.count("avg_stars").alias("total"),
            F.stddev_samp("avg_stars").alias("std"),
            F.min("avg_stars").alias("low"),
            F.max("avg_stars").alias("high"),
        )
        .where(F.col("std") > 0)
        .withColumn("bw", F.col("std") * F.pow(F.col("total").cast("double"), F.lit(-0.2)))
    )
    start = F.col("low") - cut * F.col("bw")
    step = (F.col("high") - F.col("low") + 2 * cut * F.col("bw")) / (grid_points - 1)
    grid = values.join(shape, "category").select(
        "category", "avg_stars", "n", "total", "bw",
        start.alias("start"), step.alias("step"),
        F.explode(F.sequence(F.lit(0), F.lit(grid_points - 1))).alias("point"),
    )
    x = F.col("start") + F.col("point") * F.col("step")
    z = (x - F.col("avg_stars")) / F.col("bw")
    kernel = F.exp(-0.5 * z * z) / (F.col("bw") * F.sqrt(2 * F.pi()))
    return grid.groupBy("category", "point").agg(
        F.max(x).alias("avg_stars"), F.sum(F.col("n") * kernel / F.col("total")).alias("density")
    )
