"""Topic by sentiment: summaries, target against competitors, strengths and weaknesses.

Both sides come from one aggregation keyed by ``is_target``. What follows works on its result,
at most two rows per topic.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from plaudit.constants import OTHER_TOPIC, WEAK_GAP
from plaudit.functions.labels import dominant_sentiment, net_sentiment, priority_flag

SHARES = ("pct_positive", "pct_neutral", "pct_negative")


def topic_summary(assembled: DataFrame, exclude_other: bool = False) -> DataFrame:
    """Per side and topic: review count, sentiment shares, net and dominant sentiment."""
    if exclude_other:
        assembled = assembled.where(F.col("macro_topic") != OTHER_TOPIC)

    def share(label: str):
        return (F.avg(F.when(F.col("sentiment") == label, 1).otherwise(0)) * 100).alias(f"pct_{label}")

    return (
        assembled.groupBy("is_target", "macro_topic")
        .agg(
            F.count(F.lit(1)).alias("n_reviews"),
            *(share(label) for label in ("positive", "neutral", "negative")),
            F.avg("topic_similarity").alias("avg_similarity"),
        )
        .withColumn("net_sentiment", net_sentiment(F.col("pct_positive"), F.col("pct_negative")))
        .withColumn("dominant_sentiment", dominant_sentiment(*(F.col(c) for c in SHARES)))
    )


def one_side(summary: DataFrame, is_target: bool) -> DataFrame:
    """The summary of one side, best net sentiment first."""
    return (
        summary.where(F.col("is_target") == is_target)
        .drop("is_target")
        .orderBy(F.desc("net_sentiment"), "macro_topic")
    )


def macro_distribution(summary: DataFrame) -> DataFrame:
    """Review volume per topic with its net and dominant sentiment, in no order."""
    return summary.select(
        "is_target", "macro_topic", "n_reviews", "net_sentiment", "dominant_sentiment"
    )


def _side(column: str, is_target: bool):
    return F.max(F.when(F.col("is_target") == is_target, F.col(column)))


def topic_heatmap(summary: DataFrame) -> DataFrame:
    """Sentiment shares of both sides for every topic of either, 0 where a side has none.

    Order: target net sentiment, best first; then the competitors' own topics by theirs.
    """
    wide = summary.groupBy("macro_topic").agg(
        _side("net_sentiment", True).alias("net_target"),
        _side("net_sentiment", False).alias("net_comp"),
        *(
            F.coalesce(_side(c, side), F.lit(0.0)).alias(f"{c}_{name}")
            for side, name in ((True, "target"), (False, "comp"))
            for c in SHARES
        ),
    )
    order = [
        F.desc_nulls_last("net_target"),
        # Among topics of the target only its own net sentiment and the name decide.
        F.desc(F.when(F.col("net_target").isNull(), F.col("net_comp"))),
        F.asc("macro_topic"),
    ]
    shares = [f"{c}_{name}" for name in ("target", "comp") for c in SHARES]
    return wide.select(
        F.row_number().over(Window.orderBy(*order)).cast("long").alias("position"), "macro_topic", *shares
    )


def head_to_head(summary: DataFrame) -> DataFrame:
    """Net sentiment of both sides and their gap, for the named topics both sides have, in no order."""
    both = (
        summary.where(F.col("macro_topic") != OTHER_TOPIC)
        .groupBy("macro_topic")
        .agg(
            _side("net_sentiment", True).alias("net_sentiment_target"),
            _side("n_reviews", True).alias("n_reviews_target"),
            _side("net_sentiment", False).alias("net_sentiment_comp"),
            _side("n_reviews", False).alias("n_reviews_comp"),
        )
        .where(F.col("n_reviews_target").isNotNull() & F.col("n_reviews_comp").isNotNull())
    )
    return both.withColumn("gap", F.col("net_sentiment_target") - F.col("net_sentiment_comp"))


def strengths_weaknesses(merged: DataFrame) -> DataFrame:
    """Ranked lists: strengths (gap > 0), weaknesses (gap < 0), priorities (lowest own net)."""
    gap, net = F.col("gap"), F.col("net_sentiment_target")
    lists = F.array_compact(
        F.array(
            F.when(gap > 0, F.struct(F.lit("strength").alias("list"), (-gap).alias("key"))),
            F.when(gap < 0, F.struct(F.lit("weakness").alias("list"), gap.alias("key"))),
            F.struct(F.lit("priority").alias("list"), net.alias("key")),
        )
    )
    listed = merged.select("macro_topic", "net_sentiment_target", "gap", F.inline(lists))
    rank = F.row_number().over(Window.partitionBy("list").orderBy("key", "macro_topic"))
    return listed.select(
        "list",
        rank.cast("long").alias("rank"),
        "macro_topic",
        "net_sentiment_target",
        "gap",
        F.when(F.col("list") == "priority", priority_flag(net)).alias("flag"),
    ).orderBy("list", "rank")


def weak_topics(
    merged: DataFrame, min_gap: float = WEAK_GAP, min_reviews: int = 0
) -> DataFrame:
    """Topics whose gap is below ``min_gap``, with at least ``min_reviews`` own, in no order."""
    return merged.where((F.col("gap") < min_gap) & (F.col("n_reviews_target") >= min_reviews))
