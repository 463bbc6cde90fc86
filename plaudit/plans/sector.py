"""The exploration of one sector: clean, measure, rank."""

from __future__ import annotations

from collections.abc import Collection
from typing import NamedTuple

from pyspark.sql import DataFrame

from plaudit.constants import SECTORS
from plaudit.operators import companies as C, positioning as P
from plaudit.operators.cleaning import add_length_features, clean_sector
from plaudit.plans.session import durable


class SectorReport(NamedTuple):
    """Lazy tables of one sector; the last group places the target company."""

    features: DataFrame
    stats: DataFrame
    overview: DataFrame
    star_distribution: DataFrame
    top_bottom: DataFrame
    length_boxes: DataFrame
    length_histogram: DataFrame
    longest_reviews: DataFrame
    summary: DataFrame
    stars_positioning: DataFrame
    stars_histogram: DataFrame
    sentiment_split: DataFrame
    percentile_dashboard: DataFrame
    word_count_positioning: DataFrame


def explore_sector(
    reviews: DataFrame,
    category: str,
    target: str,
    sectors: Collection[str] = SECTORS,
    keep: bool = True,
) -> SectorReport:
    """Every table of the sector exploration.

    With ``keep`` the cleaned reviews and the company statistics are written once and every
    table reads those instead of cleaning the texts again.
    """
    features = add_length_features(clean_sector(reviews, category, sectors=sectors), cleaned=True)
    if keep:
        features = durable(features, "features")
    stats = C.company_stats(features)
    if keep:
        stats = durable(stats, "stats")
    return SectorReport(
        features=features,
        stats=stats.orderBy(*C.best_first()),
        overview=C.dataset_overview(features),
        star_distribution=C.star_distribution(features),
        top_bottom=C.top_bottom_companies(stats),
        length_boxes=C.length_boxes(features),
        length_histogram=C.length_histogram(features),
        longest_reviews=C.longest_reviews(stats),
        summary=C.company_summary(stats),
        stars_positioning=P.stars_positioning(stats, target),
        stars_histogram=P.stars_histogram(stats, target),
        sentiment_split=P.sentiment_split(stats, target),
        percentile_dashboard=P.percentile_dashboard(stats, target),
        word_count_positioning=P.word_count_positioning(stats, target),
    )
