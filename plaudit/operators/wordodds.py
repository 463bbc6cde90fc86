"""Words that really differ: log-odds of target against competitors with an informative prior."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from plaudit.operators.rootcause import tokens

PRIOR_WORDS = 500.0


def _uses(is_target: bool, picked: Column) -> Column:
    return F.coalesce(F.sum(F.when((F.col("is_target") == is_target) & picked, F.col("n"))), F.lit(0).cast("long"))


def word_odds(
    assembled: DataFrame,
    prior_words: float = PRIOR_WORDS,
    sentiment: str | None = "negative",
    topic: str = "macro_topic",
    text: str = "review",
) -> DataFrame:
    """``topic, word, n_target, n_comp, log_odds, z`` for every word of a topic.

    The prior is the word's share of all countable words of all reviews, worth ``prior_words`` words, so
    that a rare word needs more than a few uses to stand out. ``log_odds`` is the log of the word's odds
    among the target's words of the topic less that among the competitors', and ``z`` is it in standard
    deviations. ``sentiment`` picks the reviews that are compared (all if None); the prior is over all.
    A topic that one side has no words in is compared with the prior alone. Texts without countable
    words and null texts give nothing.

    Words are counted once, by topic, side and sentiment; all else works on those counts.
    """
    if prior_words <= 0:
        raise ValueError("prior_words must be more than 0")
    counted = tokens(assembled, ["is_target", topic, "sentiment"], text).groupBy("is_target", topic, "sentiment", "word").agg(
        F.count(F.lit(1)).alias("n")
    )
    picked = F.lit(True) if sentiment is None else F.col("sentiment").eqNullSafe(F.lit(sentiment))
    # One row per word and topic, with all uses in a column of its own; then a word's rows meet, at
    # most one a topic, for the share of the word among all words.
    by_topic = counted.groupBy(topic, "word").agg(
        _uses(True, picked).alias("n_target"), _uses(False, picked).alias("n_comp"), F.sum("n").alias("n_all")
    )
    overall = F.sum("n_all").over(Window.partitionBy("word")).alias("overall")
    rows = by_topic.select(topic, "word", "n_target", "n_comp", "n_all", overall)
    sizes = by_topic.groupBy(F.col(topic).alias("_topic")).agg(
        F.sum("n_target").alias("size_target"), F.sum("n_comp").alias("size_comp"), F.sum("n_all").alias("size_all")
    ).withColumn("total", F.sum("size_all").over(Window.partitionBy(F.lit(0))))  # one row a topic
    prior = F.col("overall") / F.col("total") * F.lit(float(prior_words))
    alpha = F.col("alpha")

    def odds(name: str) -> Column:
        uses = F.col(f"n_{name}") + alpha
        return F.log(uses) - F.log(F.col(f"size_{name}") + F.lit(float(prior_words)) - uses)

    spread = F.sqrt(1 / (F.col("n_target") + alpha) + 1 / (F.col("n_comp") + alpha))
    return (
        rows.where((F.col("n_target") > 0) | (F.col("n_comp") > 0))
        .join(sizes, F.col(topic).eqNullSafe(F.col("_topic")))
        .withColumn("alpha", prior)
        .withColumn("log_odds", odds("target") - odds("comp"))
        .withColumn("z", F.col("log_odds") / spread)
        .select(topic, "word", "n_target", "n_comp", "log_odds", "z")
    )


def distinctive_words(odds: DataFrame, top_n: int = 15, min_z: float = 1.96, topic: str = "macro_topic", by: Sequence[str] = ()) -> DataFrame:
    """``topic, side, rank, word, z`` of the words that stand out most on each side, beyond ``min_z``."""
    side = F.when(F.col("z") > 0, "target").otherwise("competitors")
    rank = F.row_number().over(Window.partitionBy(topic, "side").orderBy(F.desc(F.abs("z")), "word")).cast("long")
    return (
        odds.where(F.abs("z") >= min_z)
        .withColumn("side", side)
        .withColumn("rank", rank)
        .where(F.col("rank") <= top_n)
        .select(topic, "side", "rank", "word", "z", *by)
    )
