"""The whole comparison of one company with its competitors."""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import DataFrame, functions as F

from plaudit.constants import MIN_TARGET_REVIEWS, SIMILARITY_THRESHOLD, WEAK_GAP
from plaudit.operators.cleaning import add_star_sentiment
from plaudit.operators.compare import head_to_head, one_side, topic_summary
from plaudit.operators.models import (
    Classifier,
    Encoder,
    embed_texts,
    score_sentiment,
    topic_seeds,
)
from plaudit.operators.rootcause import RootCause, root_cause
from plaudit.operators.topics import assign_topics, collect_topics, seed_centroids, split_target
from plaudit.plans.session import durable

RESULTS = ("topic_id", "macro_topic", "topic_similarity", "sentiment", "sentiment_score", "sentiment_num")


class Comparison(NamedTuple):
    """Lazy results; the first two are the assembled reviews of each side."""

    target: DataFrame
    competitors: DataFrame
    summary_target: DataFrame
    summary_competitors: DataFrame
    centroids: DataFrame
    merged: DataFrame
    root_cause: RootCause


def assemble(
    reviews: DataFrame,
    target: str,
    centroids: DataFrame,
    threshold: float = SIMILARITY_THRESHOLD,
    classifier_factory: Callable[[], Classifier] | None = None,
) -> DataFrame:
    """Reviews with vectors → the same rows with side, topic and sentiment; row-wise throughout."""
    return _label(split_target(reviews, target), centroids, threshold, classifier_factory)


def _label(
    flagged: DataFrame,
    centroids: DataFrame,
    threshold: float,
    classifier_factory: Callable[[], Classifier] | None,
) -> DataFrame:
    assigned = assign_topics(flagged, collect_topics(centroids), threshold).drop("embedding")
    if classifier_factory is None:
        return add_star_sentiment(assigned)
    return score_sentiment(assigned, "review", classifier_factory)


def compare_company(
    reviews: DataFrame,
    target: str,
    encoder_factory: Callable[[], Encoder] | None = None,
    centroids: DataFrame | None = None,
    classifier_factory: Callable[[], Classifier] | None = None,
    min_gap: float = WEAK_GAP,
    min_reviews: int = MIN_TARGET_REVIEWS,
    max_reviews: int | None = None,
    threshold: float = SIMILARITY_THRESHOLD,
    keep: bool = True,
) -> Comparison:
    """Split, embed, assign topics, label sentiment and compare the two sides.

    Reviews bring an ``embedding`` column or are embedded here; the same encoder embeds the topic
    seeds unless ``centroids`` are given. Sentiment comes from the stars unless a classifier is
    given. With ``keep`` the assembled reviews are written once, so that the models run once
    however many of the results are read.
    """
    if encoder_factory is None and (centroids is None or "embedding" not in reviews.columns):
        raise ValueError("give an encoder, or reviews with an embedding column and centroids")
    if centroids is None:
        seeds = embed_texts(topic_seeds(reviews.sparkSession), "seed", encoder_factory)
        centroids = seed_centroids(seeds)
    flagged = split_target(reviews, target)  # before embedding, so blank reviews cost nothing
    if "embedding" not in flagged.columns:
        flagged = embed_texts(flagged, "review", encoder_factory)
    assembled = _label(flagged, centroids, threshold, classifier_factory)
    if keep:
        assembled = durable(assembled, "assembled")
    summary = topic_summary(assembled)
    merged = head_to_head(summary)
    return Comparison(
        target=assembled.where(F.col("is_target")),
        competitors=assembled.where(~F.col("is_target")),
        summary_target=one_side(summary, True),
        summary_competitors=one_side(summary, False),
        centroids=centroids,
        merged=merged,
        root_cause=root_cause(assembled, merged, min_gap, min_reviews, max_reviews),
    )
