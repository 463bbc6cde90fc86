"""Root cause of weak topics: the reviews and the words behind them."""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import DataFrame, Window, functions as F

from plaudit.constants import (
    MIN_TARGET_REVIEWS,
    MIN_TOKEN_LENGTH,
    STOP_WORDS,
    WEAK_GAP,
)
from plaudit.functions import text as X
from plaudit.operators.compare import weak_topics

REVIEW_COLUMNS = (
    "company",
    "stars",
    "macro_topic",
    "topic_similarity",
    "sentiment",
    "sentiment_score",
    "title",
    "review",
)


def extract_reviews(
    assembled: DataFrame,
    macro_topic: str | None = None,
    sentiment: str = "negative",
    columns: Sequence[str] = REVIEW_COLUMNS,
    ordered: bool = False,
) -> DataFrame:
    """Reviews of a topic (all topics if None) with one sentiment or ``'all'``.

    ``ordered`` sorts them, worst first. A global sort first samples its input, which computes the
    rows twice; sort a table that is written already. The review id breaks ties, which also keeps
    the range partitions even.
    """
    rows = assembled
    if macro_topic is not None:
        rows = rows.where(F.col("macro_topic") == macro_topic)
    if sentiment != "all":
        rows = rows.where(F.col("sentiment") == sentiment)
    key = [c for c in ("review_id",) if c in rows.columns]
    kept = [*key, *(c for c in columns if c in rows.columns)]
    kept_rows = rows.select(*kept)
    return kept_rows.orderBy("stars", *key) if ordered else kept_rows


def tokens(
    rows: DataFrame,
    keep: Sequence[str],
    text: str = "review",
    stop_words: Sequence[str] = STOP_WORDS,
    min_length: int = MIN_TOKEN_LENGTH,
) -> DataFrame:
    """One row per countable word: ``keep, word``."""
    exploded = rows.select(*keep, F.explode(X.words(F.lower(F.col(text)))).alias("word"))
    bare = exploded.withColumn("word", X.bare_token(F.col("word")))
    return bare.where(X.is_countable(F.col("word"), stop_words, min_length))


def top_words(counted: DataFrame, keys: Sequence[str], top_n: int, n: str = "n") -> DataFrame:
    """The most frequent words per group; Spark cuts every group to ``top_n`` before shuffling."""
    w = Window.partitionBy(*keys).orderBy(F.desc(n), "word")
    return counted.withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= top_n)


def word_frequencies(assembled: DataFrame, top_n: int = 15) -> DataFrame:
    """Most common words of the negative reviews, per side and topic."""
    keys = ["is_target", "macro_topic"]
    negative = assembled.where(F.col("sentiment") == "negative")
    counted = tokens(negative, keys).groupBy(*keys, "word").agg(F.count(F.lit(1)).alias("n"))
    return top_words(counted, keys, top_n).select(*keys, "rank", "word", "n")


def words_and_tone(assembled: DataFrame, top_n: int = 20) -> DataFrame:
    """Most used words with the mean sentiment of their uses, per side."""
    counted = (
        tokens(assembled, ["is_target", "sentiment_num"])
        .groupBy("is_target", "word")
        .agg(F.count(F.lit(1)).alias("n"), F.avg("sentiment_num").alias("avg_sentiment"))
    )
    return top_words(counted, ["is_target"], top_n).select(
        "is_target", "rank", "word", "n", "avg_sentiment"
    )


class RootCause(NamedTuple):
    """Lazy tables of a root-cause report."""

    topics: DataFrame
    negative_reviews: DataFrame
    words: DataFrame


def root_cause(
    assembled: DataFrame,
    merged: DataFrame,
    min_gap: float = WEAK_GAP,
    min_reviews: int = MIN_TARGET_REVIEWS,
    max_reviews: int | None = None,
    top_words_n: int = 15,
) -> RootCause:
    """Weak topics, the target's negative reviews in them, and the words of both sides.

    ``assembled`` is read for each of them: pass a table that is written already. ``max_reviews`` shows that many of the worst reviews per topic; by default all are kept.
    The weak-topic list has at most one row per topic; Spark sizes it before it broadcasts.
    """
    weak = weak_topics(merged, min_gap, min_reviews)
    names = weak.select("macro_topic")
    in_weak = assembled.join(names, "macro_topic", "left_semi")
    negative = extract_reviews(in_weak.where(F.col("is_target")))
    if max_reviews is not None:
        key = [c for c in ("review_id",) if c in negative.columns]
        w = Window.partitionBy("macro_topic").orderBy("stars", *key)
        negative = (
            negative.withColumn("shown", F.row_number().over(w))
            .where(F.col("shown") <= max_reviews)
            .drop("shown")
        )
    return RootCause(weak, negative, word_frequencies(in_weak, top_words_n))
