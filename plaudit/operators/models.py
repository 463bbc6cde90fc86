"""Pluggable models: text embedding and sentiment classification as Arrow-batched jobs.

The caller supplies a factory without arguments. It runs once per Python worker process, not
per task or batch, so a large model is loaded once and used for every task of the worker: the
package is shipped as an archive that workers import, and keeps the models they loaded. The
functions are declared nondeterministic, which makes Spark call them once per row: a filter on
their result is never pushed below them as a second call.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from plaudit.constants import TOPIC_SEEDS
from plaudit.functions.labels import sentiment_number
from plaudit.plans.session import ship_package

Encoder = Callable[[list[str]], np.ndarray]
Classifier = Callable[[list[str]], Sequence[Mapping[str, object]]]

# Models that a worker holds at the same time.
HELD = 4
_LOADED: dict[str, object] = {}


def _factory_key(factory: Callable[[], object]) -> str:
    """The same for the same factory with the same captured values."""
    return hashlib.sha256(cloudpickle.dumps(factory)).hexdigest()


def _load_once(key: str, factory: Callable[[], object]):
    """The worker's model of this key; of more than ``HELD``, the one unused longest goes."""
    model = _LOADED.pop(key) if key in _LOADED else factory()
    _LOADED[key] = model
    while len(_LOADED) > HELD:
        del _LOADED[next(iter(_LOADED))]
    return model


def _slices(texts: list[str], size: int) -> Iterator[list[str]]:
    return (texts[i : i + size] for i in range(0, len(texts), size))


def embed_texts(
    rows: DataFrame,
    text_column: str,
    encoder_factory: Callable[[], Encoder],
    output: str = "embedding",
    batch_size: int = 64,
) -> DataFrame:
    """Add one float vector per text. The encoder maps a list of texts to an (n, d) array."""
    ship_package(rows.sparkSession)
    key = _factory_key(encoder_factory)

    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def embed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encoder = _load_once(key, encoder_factory)
        for texts in batches:
            vectors: list = []
            for part in _slices(texts.fillna("").tolist(), batch_size):
                vectors.extend(np.asarray(encoder(part), dtype=np.float32))
            yield pd.Series(vectors, dtype=object)

    return rows.withColumn(output, embed.asNondeterministic()(F.col(text_column)))


def topic_seeds(
    spark: SparkSession, seeds: Mapping[str, Sequence[str]] = TOPIC_SEEDS
) -> DataFrame:
    """The seed words of every topic: ``topic_id, macro_topic, seed``."""
    rows = [
        (number, topic, seed)
        for number, (topic, seed_words) in enumerate(seeds.items())
        for seed in seed_words
    ]
    return spark.createDataFrame(rows, "topic_id int, macro_topic string, seed string")


def score_sentiment(
    rows: DataFrame,
    text_column: str,
    classifier_factory: Callable[[], Classifier],
    batch_size: int = 32,
) -> DataFrame:
    """Add ``sentiment``, ``sentiment_score`` and ``sentiment_num`` from a text classifier.

    The classifier maps a list of texts to one ``{"label", "score"}`` each; truncation is its
    own matter. Blank texts are scored as the word "neutral".
    """
    ship_package(rows.sparkSession)
    key = _factory_key(classifier_factory)

    @F.pandas_udf(T.StructType([
        T.StructField("label", T.StringType()), T.StructField("score", T.DoubleType()),
    ]))
    def classify(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        classifier = _load_once(key, classifier_factory)
        for texts in batches:
            filled = [t if t.strip() else "neutral" for t in texts.fillna("").tolist()]
            found = [r for part in _slices(filled, batch_size) for r in classifier(part)]
            yield pd.DataFrame(
                {
                    "label": [str(r["label"]).lower() for r in found],
                    "score": [float(r["score"]) for r in found],
                }
            )

    scored = rows.withColumn("_scored", classify.asNondeterministic()(F.col(text_column)))
    return scored.withColumns(
        {
            "sentiment": F.col("_scored.label"),
            "sentiment_score": F.col("_scored.score"),
            "sentiment_num": sentiment_number(F.col("_scored.label")),
        }
    ).drop("_scored")
