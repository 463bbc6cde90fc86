"""Dataset overview, company statistics and the tables drawn from them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from plaudit.functions import text as X
from plaudit.functions.labels import formatted, length_tier, round2, stats_tiers
from plaudit.operators.cleaning import add_length_features
from plaudit.operators.distribution import (
    box_statistics,
    frequencies,
    histogram,
    quantiles,
    ranked,
    shares,
)

COMPANY = ("category", "company")
METRICS = (
    "avg_stars",
    "pct_positive",
    "pct_neutral",
    "pct_negative",
    "avg_review_words",
    "avg_title_words",
    "review_word_count",
    "wc_positive",
    "wc_neutral",
    "wc_negative",
    "review_count",
)
SUMMARY_METRICS = (
    "review_count",
    "avg_stars",
    "pct_positive",
    "pct_negative",
    "avg_review_words",
    "avg_title_words",
)


def dataset_overview(reviews: DataFrame) -> DataFrame:
    """Null and blank counts of title, review and stars beside the headline figures."""
    headline = ["total_reviews", "unique_companies", "min_stars", "max_stars", "avg_stars"]
    checked = ("title", "review", "stars")
    counts = reviews.agg(
        F.count(F.lit(1)).alias("total_reviews"),
        F.count_distinct("company").alias("unique_companies"),
        F.min("stars").cast("int").alias("min_stars"),
        F.max("stars").cast("int").alias("max_stars"),
        F.avg("stars").alias("avg_stars"),
        *(F.count_if(F.col(c).isNull()).alias(f"nulls_{c}") for c in checked),
        *(
            F.count_if(F.col(c).isNotNull() & X.is_blank(F.col(c))).alias(f"empty_{c}")
            for c in checked[:2]
        ),
    ).withColumn("empty_stars", F.lit(0).cast("long"))
    pairs = ", ".join(f"'{c}', nulls_{c}, empty_{c}" for c in checked)
    return counts.select(
        F.expr(f"stack({len(checked)}, {pairs}) AS (column, nulls, empty_strings)"), *headline
    )


def star_distribution(reviews: DataFrame, by: Sequence[str] = ("category",)) -> DataFrame:
    """Reviews per star value and their share of all rated reviews."""
    return shares(reviews, by, "stars").orderBy(*by, "stars")


def category_share(rows: DataFrame) -> DataFrame:
    """Share of every sector among the rows (reviews or companies)."""
    return shares(rows, (), "category").orderBy(F.desc("n"), "category")


DESCRIBE_POINTS = {"p25": 0.25, "p50": 0.5, "p75": 0.75}


def describe(rows: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Count, mean, sample deviation, extremes and exact quartiles, one row per column."""
    long = stacked(rows, columns, by)
    keys = [*by, "metric"]
    values = ranked(frequencies(long, keys, "value"), keys, "value")
    spread = long.groupBy(*keys).agg(
        F.count("value").alias("count"),
        F.avg("value").alias("mean"),
        F.stddev_samp("value").alias("std"),
        F.min("value").alias("min"),
        F.max("value").alias("max"),
    )
    points = quantiles(values, keys, "value", DESCRIBE_POINTS).drop("total")
    return spread.join(points, keys, "left").select(
        *keys, "count", "mean", "std", "min", *DESCRIBE_POINTS, "max"
    )


def stacked(rows: DataFrame, columns: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """One row per kept key and column: ``keep, metric, value double``."""
    return rows.select(*keep, *(F.col(c).cast("double").alias(c) for c in columns)).unpivot(
        list(keep), list(columns), "metric", "value"
    )


def company_stats(reviews: DataFrame, ordered: bool = False) -> DataFrame:
    """Eleven rounded metrics per sector and company; one aggregation with map-side combine.

    Reviews without a sector or company are left out. ``ordered`` adds the best-rated-first sort,
    which later aggregations do not need.
    """
    if "review_word_count" not in reviews.columns:
        reviews = add_length_features(reviews)
    words = F.col("review_word_count")
    tiers = stats_tiers(F.col("stars"))
    metrics = {
        "avg_stars": F.avg("stars"),
        **{
            f"pct_{tier}": F.avg(F.when(inside, 1).otherwise(0)) * 100
            for tier, inside in tiers.items()
        },
        "avg_review_words": F.avg(words),
        "avg_title_words": F.avg("title_word_count"),
        "review_word_count": F.avg(words),
        **{
            f"wc_{tier}": F.coalesce(F.avg(F.when(inside, words)), F.lit(0.0))
            for tier, inside in tiers.items()
        },
    }
    stats = (
        # Stated here for both keys, so that no consumer adds a null filter of its own and thereby
        # loses the reuse of this shuffle.
        reviews.where(F.col("category").isNotNull() & F.col("company").isNotNull())
        .groupBy(*COMPANY)
        .agg(
            *(round2(metric).alias(name) for name, metric in metrics.items()),
            F.count("review").alias("review_count"),
        )
    )
    return stats.orderBy(*best_first()) if ordered else stats


def best_first():
    return [F.desc_nulls_last("avg_stars"), F.asc("company"), F.asc("category")]


def _top(stats: DataFrame, n: int, *order) -> DataFrame:
    # row_number <= n lets Spark cut every map-side group to n rows before the shuffle.
    w = Window.partitionBy("category").orderBy(*order)
    return stats.withColumn("position", F.row_number().over(w)).where(F.col("position") <= n)


def top_bottom_companies(stats: DataFrame, top_n: int = 10) -> DataFrame:
    """Best and worst rated companies of each sector, with the mean of the shown ones."""
    top = _top(stats, top_n, F.desc_nulls_last("avg_stars"), F.asc("company"))
    bottom = _top(stats, top_n, F.asc_nulls_first("avg_stars"), F.desc("company"))
    shown = top.withColumn("side", F.lit("top")).unionByName(
        bottom.withColumn("side", F.lit("bottom"))
    )
    side_mean = F.avg("avg_stars").over(Window.partitionBy("category", "side"))
    return shown.select(
        "category", "side", "position", "company", "avg_stars", side_mean.alias("side_mean")
    )


def longest_reviews(stats: DataFrame, top_n: int = 15) -> DataFrame:
    """Companies of each sector with the most words per review."""
    rated = stats.where(F.col("avg_review_words").isNotNull())
    return _top(rated, top_n, F.desc("avg_review_words"), F.asc("company")).select(
        "category", "position", "company", "avg_review_words", "avg_stars"
    )


def company_summary(stats: DataFrame, top_n: int = 20, display: bool = False) -> DataFrame:
    """Best-rated companies of each sector with six metrics, as numbers or as display text."""
    best = _top(stats, top_n, F.desc_nulls_last("avg_stars"), F.asc("company")).select(
        "category", "position", "company", *SUMMARY_METRICS
    )
    if not display:
        return best
    return best.withColumns(
        {
            "avg_stars": formatted(F.col("avg_stars"), 2),
            "pct_positive": formatted(F.col("pct_positive"), 1, "%"),
            "pct_negative": formatted(F.col("pct_negative"), 1, "%"),
            "avg_review_words": formatted(F.col("avg_review_words"), 0),
            "avg_title_words": formatted(F.col("avg_title_words"), 0),
        }
    )


def _with_tier(reviews: DataFrame) -> DataFrame:
    return reviews.withColumn("tier", length_tier(F.col("stars")))


def length_boxes(reviews: DataFrame) -> DataFrame:
    """Box statistics of review word counts per sector and tier."""
    return box_statistics(_with_tier(reviews), ["category", "tier"], "review_word_count")


def length_histogram(reviews: DataFrame, bins: int = 40) -> DataFrame:
    """Density histogram of review word counts per sector and tier."""
    return histogram(_with_tier(reviews), ["category", "tier"], "review_word_count", bins)


def length_limits(reviews: DataFrame, points=(("p97", 0.97), ("p99", 0.99))) -> DataFrame:
    """Upper quantiles of review word counts per sector (the axis limits of the charts)."""
    keys = ["category"]
    values = ranked(
        frequencies(reviews, keys, "review_word_count"), keys, "review_word_count"
    )
    return quantiles(values, keys, "review_word_count", dict(points)).withColumnRenamed(
        "total", "n"
    )
