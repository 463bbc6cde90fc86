"""Star tiers, sentiment labels and display formats as Spark expressions.

Three tier rules exist side by side and differ for null and fractional stars; keep them apart.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from plaudit.constants import (
    AMBER_BELOW,
    NEGATIVE_SCORE,
    NEUTRAL_SCORE,
    POSITIVE_SCORE,
    RED_BELOW,
    SENTIMENT_NUMBERS,
)

POSITIVE_TIER, NEUTRAL_TIER, NEGATIVE_TIER = "Positive (4-5)", "Neutral (3)", "Negative (1-2)"


def stats_tiers(stars: Column) -> dict[str, Column]:
    """Tier conditions of the company statistics; null and 2.5 / 3.5 stars are in no tier."""
    return {"positive": stars >= 4, "neutral": stars == 3, "negative": stars <= 2}


def length_tier(stars: Column) -> Column:
    """Tier label of the length tables; whatever is neither high nor low is neutral."""
    return (
        F.when(stars >= 4, POSITIVE_TIER)
        .when(stars <= 2, NEGATIVE_TIER)
        .otherwise(NEUTRAL_TIER)
    )


def star_sentiment(stars: Column) -> dict[str, Column]:
    """Sentiment, score and number from stars; whatever is not high or 3 is negative."""

    def choose(positive, neutral, negative):
        return F.when(stars >= 4, positive).when(stars == 3, neutral).otherwise(negative)

    return {
        "sentiment": choose("positive", "neutral", "negative"),
        "sentiment_score": choose(POSITIVE_SCORE, NEUTRAL_SCORE, NEGATIVE_SCORE),
        "sentiment_num": choose(*(SENTIMENT_NUMBERS[s] for s in ("positive", "neutral", "negative"))),
    }


def sentiment_number(label: Column) -> Column:
    """1, 0 or -1 for a lower-cased label; null when it is unknown."""
    number = F.lit(None).cast("int")
    for name, value in SENTIMENT_NUMBERS.items():
        number = F.when(F.lower(label) == name, value).otherwise(number)
    return number


def dominant_sentiment(positive: Column, neutral: Column, negative: Column) -> Column:
    """Label of the largest share; the earlier one wins a tie."""
    return (
        F.when((positive >= neutral) & (positive >= negative), "positive")
        .when(neutral >= negative, "neutral")
        .otherwise("negative")
    )


def net_sentiment(positive: Column, negative: Column) -> Column:
    return positive - negative


def priority_flag(net: Column) -> Column:
    return F.when(net < RED_BELOW, "red").when(net < AMBER_BELOW, "amber").otherwise("green")


def round2(value: Column) -> Column:
    """Two decimals, half to even on the scaled value."""
    return F.rint(value * 100) / 100


def formatted(value: Column, decimals: int, suffix: str = "") -> Column:
    """Fixed-point text without grouping, rounded half-even on the binary value."""
    pattern = "0." + "0" * decimals if decimals else "0"
    text = F.call_function("format_number", value, F.lit(pattern))
    return F.concat(text, F.lit(suffix)) if suffix else text
