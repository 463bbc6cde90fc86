"""The row-wise part of the analysis, for batch and streaming DataFrames alike."""

from __future__ import annotations

from pyspark.sql import DataFrame

from plaudit.operators.cleaning import add_length_features, add_star_sentiment, clean_reviews


def prepare_reviews(reviews: DataFrame) -> DataFrame:
    """Clean, measure and label reviews. No state and no shuffle, so no watermark is needed."""
    return add_star_sentiment(add_length_features(clean_reviews(reviews), cleaned=True))
