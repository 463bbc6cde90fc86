"""Target split, topic centroids and topic assignment by cosine similarity."""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, Window, functions as F, types as T

from plaudit.constants import OTHER_TOPIC, OTHER_TOPIC_ID, SIMILARITY_THRESHOLD
from plaudit.functions.text import is_blank


def flag_target(reviews: DataFrame, target: str) -> DataFrame:
    """Add ``is_target`` and drop reviews without text. Reviews without a company are rivals'."""
    return reviews.where(~is_blank(F.col("review"))).withColumn(
        "is_target", F.col("company").eqNullSafe(F.lit(target))
    )


def split_target(reviews: DataFrame, target: str) -> DataFrame:
    """:func:`flag_target`, after a look whether the target occurs at all (ValueError if not)."""
    if reviews.where(F.col("company") == target).limit(1).isEmpty():
        raise ValueError(f"target company {target!r} not found")
    return flag_target(reviews, target)


def seed_centroids(seeds: DataFrame) -> DataFrame:
    """Mean seed vector per topic, not re-normalised: ``topic_id, macro_topic, centroid``.

    Expects ``topic_id, macro_topic, embedding``. Partial means merge map-side, so the shuffle
    carries one vector per topic and task.
    """
    return (
        seeds.where(F.col("embedding").isNotNull())
        .groupBy("topic_id", "macro_topic")
        .agg(Summarizer.mean(array_to_vector("embedding")).alias("centroid"))
        .withColumn("centroid", vector_to_array("centroid"))
    )


class Topics(NamedTuple):
    """Topic centroids as held by the driver and sent to the workers."""

    ids: list[int]
    names: list[str]
    matrix: np.ndarray


def collect_topics(centroids: DataFrame) -> Topics:
    """Bring the centroids to the driver: one row per topic, a fixed list of business topics.

    The expected size is tens of rows, thousands at most: names become literals of the plan. Spark
    itself fails the collect beyond ``spark.driver.maxResultSize``.
    """
    rows = centroids.select("topic_id", "macro_topic", "centroid").orderBy("topic_id").collect()
    if not rows:
        raise ValueError("no topic centroids")
    return Topics(
        [r.topic_id for r in rows],
        [r.macro_topic for r in rows],
        np.array([r.centroid for r in rows], dtype=np.float64),
    )


_BLOCK = 1 << 22


def _best_topic(matrix: np.ndarray):
    norms = np.linalg.norm(matrix, axis=1)
    unit = (matrix / np.where(norms == 0, 1.0, norms)[:, None]).T.copy()
    width, n_topics = unit.shape

    @F.arrow_udf(T.StructType([
        T.StructField("index", T.IntegerType()), T.StructField("similarity", T.DoubleType()),
    ]))
    def best(vectors: pa.Array) -> pa.Array:
        index = np.zeros(len(vectors), dtype=np.int32)
        similarity = np.zeros(len(vectors), dtype=np.float64)
        missing = vectors.is_null().to_numpy(zero_copy_only=False).copy()
        present = np.flatnonzero(~missing)
        flat = vectors.drop_null().flatten().to_numpy(zero_copy_only=False)
        if flat.size != present.size * width:
            raise ValueError(f"every embedding must have {width} values, as the centroids do")
        rows = flat.astype(np.float64).reshape(-1, width)
        # Blocks bound the similarity matrix, however many topics there are.
        step = max(1, _BLOCK // n_topics)
        for start in range(0, present.size, step):
            block = rows[start : start + step]
            at = present[start : start + step]
            bad = ~np.isfinite(block).all(axis=1)  # null elements are NaN here
            missing[at[bad]] = True
            block = np.where(bad[:, None], 0.0, block)
            length = np.linalg.norm(block, axis=1)
            scores = (block / np.where(length == 0, 1.0, length)[:, None]) @ unit
            winner = scores.argmax(axis=1)
            index[at] = winner
            similarity[at] = scores[np.arange(len(block)), winner]
        return pa.StructArray.from_arrays(
            [pa.array(index, mask=missing), pa.array(similarity, mask=missing)],
            names=["index", "similarity"],
        )

    # One call per row, also below filters on the assigned topic.
    return best.asNondeterministic()


def assign_topics(
    reviews: DataFrame,
    topics: Topics,
    threshold: float = SIMILARITY_THRESHOLD,
    embedding: str = "embedding",
) -> DataFrame:
    """Add ``topic_id, macro_topic, topic_similarity``: the closest centroid by cosine.

    Below ``threshold`` (which itself is enough), or without a vector, the topic is the catch-all
    one; the best similarity is kept either way. The first topic wins a tie; a zero vector has
    similarity 0. A vector with a null, NaN or infinite element counts as none. Row-wise: no shuffle.
    """
    labels = F.array(
        *(
            F.struct(F.lit(i).cast("int").alias("id"), F.lit(name).alias("name"))
            for i, name in zip(topics.ids, topics.names)
        )
    )
    other = F.struct(
        F.lit(OTHER_TOPIC_ID).cast("int").alias("id"), F.lit(OTHER_TOPIC).alias("name")
    )
    chosen = F.when(
        F.col("_best.similarity") >= threshold, F.get(labels, F.col("_best.index"))
    ).otherwise(other)
    return (
        reviews.withColumn("_best", _best_topic(topics.matrix)(F.col(embedding)))
        .withColumn("_topic", chosen)
        .withColumns(
            {
                "topic_id": F.col("_topic.id"),
                "macro_topic": F.col("_topic.name"),
                "topic_similarity": F.col("_best.similarity"),
            }
        )
        .drop("_best", "_topic")
    )


def assignment_distribution(assigned: DataFrame) -> DataFrame:
    """Reviews and share per assigned topic, for target and competitors; at most two rows a topic."""
    counted = assigned.groupBy("is_target", "macro_topic").agg(F.count(F.lit(1)).alias("n_reviews"))
    side = Window.partitionBy("is_target")
    return counted.withColumn("pct", F.col("n_reviews") / F.sum("n_reviews").over(side) * 100)
