"""Sector selection, cleaning and review-level features."""

from __future__ import annotations

from collections.abc import Collection, Sequence

from pyspark.sql import DataFrame, functions as F

from plaudit.constants import FULL_COMPANY_REVIEWS, SECTORS, TEXT_COLUMNS
from plaudit.functions import text as X
from plaudit.functions.labels import star_sentiment
from plaudit.sources.reviews import require_columns, require_sector


def clean_reviews(reviews: DataFrame, text_columns: Sequence[str] = TEXT_COLUMNS) -> DataFrame:
    """Clean the listed text columns that exist and flag reviews left without text."""
    cleaned = X.clean_text(reviews, [c for c in text_columns if c in reviews.columns])
    if "review" not in reviews.columns:
        return cleaned
    return cleaned.withColumn("is_empty_review", X.is_blank(F.col("review")))


def clean_sector(
    reviews: DataFrame,
    category: str,
    text_columns: Sequence[str] = TEXT_COLUMNS,
    sectors: Collection[str] = SECTORS,
) -> DataFrame:
    """Reviews of one sector with cleaned text; the filter runs before any cleaning."""
    require_sector(category, sectors)
    require_columns(reviews)
    return clean_reviews(reviews.where(F.col("category") == category), text_columns)


def add_length_features(reviews: DataFrame, cleaned: bool = False) -> DataFrame:
    """Character and word counts of title and review.

    ``cleaned`` promises texts out of :func:`clean_reviews`, whose words are cheaper to count.
    """
    count_words = X.cleaned_word_count if cleaned else X.word_count
    features = {}
    for c in ("title", "review"):
        features[f"{c}_char_len"] = X.char_length(F.col(c))
        features[f"{c}_word_count"] = count_words(F.col(c))
    return reviews.withColumns(features)


def add_star_sentiment(reviews: DataFrame) -> DataFrame:
    """``sentiment``, ``sentiment_score`` and ``sentiment_num`` from the stars."""
    return reviews.withColumns(star_sentiment(F.col("stars")))


def companies_with_reviews(
    reviews: DataFrame, n: int | None = FULL_COMPANY_REVIEWS, keys: Sequence[str] = ("company",)
) -> DataFrame:
    """Companies with exactly ``n`` reviews, by ``keys``; null keys are no company.

    Without ``n`` it is the number of reviews that most companies have, the smaller on ties: the size
    at which the data was cut off. It is found and used inside the plan, one row that Spark sizes itself.
    """
    counted = reviews.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_reviews"))
    for key in keys:
        counted = counted.where(F.col(key).isNotNull())
    if n is not None:
        return counted.where(F.col("n_reviews") == n)
    usual = counted.groupBy("n_reviews").agg(F.count(F.lit(1)).alias("_companies")).orderBy(F.desc("_companies"), "n_reviews").limit(1)
    return counted.join(usual.select("n_reviews"), "n_reviews", "left_semi").select(*keys, "n_reviews")


def reviews_of_companies(reviews: DataFrame, companies: DataFrame, keys: Sequence[str] = ("company",)) -> DataFrame:
    """Reviews whose company is in the list."""
    return reviews.join(companies.select(*keys), list(keys), "left_semi")


def company_values(
    reviews: DataFrame, column: str, company: str | None = None, category: str | None = None
) -> DataFrame:
    """Distinct values of a column, for one company and / or one sector if given."""
    for name, value in (("company", company), ("category", category)):
        if value is not None:
            reviews = reviews.where(F.col(name) == value)
    return reviews.select(*dict.fromkeys(["category", "company", column])).distinct()
