"""Topic discovery from embeddings, topic keywords and a 2-D view of the vectors."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, Window, functions as F

from plaudit.functions.vectors import is_finite_vector
from plaudit.operators.rootcause import tokens, top_words

MAX_TOPICS = 12
SEED = 42


def discover_topics(
    reviews: DataFrame,
    k: int = MAX_TOPICS,
    components: int = 5,
    seed: int = SEED,
    embedding: str = "embedding",
    rounds: int | None = None,
) -> DataFrame:
    """Cluster reduced embeddings; fitted on the competitors, applied to both sides.

    Adds ``discovered_topic``, null without a vector; one with a null, NaN or infinite element counts as
    none. With ``rounds`` the result can be told in advance: centres start at the competitors' ``k``
    reviews with the smallest ids and move so many times; without, Spark picks starts by ``seed`` and
    stops by itself. The training vectors are kept on disk or in memory while KMeans iterates over them,
    and are recomputed if an executor is lost.
    """
    if k < 2:
        raise ValueError("k must be 2 or more")
    keep = ["is_target"] if rounds is None else ["is_target", "review_id"]
    vectors = _narrow(reviews, embedding, *keep).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        fitting = vectors.where(~F.col("is_target")).drop("is_target")
        pca = PCA(k=components, inputCol="_vector", outputCol="_reduced").fit(fitting)
        training = pca.transform(fitting).drop("_vector").persist(StorageLevel.MEMORY_AND_DISK)
        try:
            if rounds is None:
                model = KMeans(
                    k=k, seed=seed, featuresCol="_reduced", predictionCol="_cluster"
                ).fit(training)
            else:
                centres = _moved_centres(training, k, rounds)
        finally:
            training.unpersist()
    finally:
        vectors.unpersist()
    known = is_finite_vector(F.col(embedding))
    present = pca.transform(reviews.where(known).withColumn("_vector", array_to_vector(F.col(embedding))))
    if rounds is None:
        found = model.transform(present)
    else:
        found = present.withColumn("_cluster", _nearest(centres)(vector_to_array("_reduced")))
    absent = reviews.where(~known).withColumn("discovered_topic", F.lit(None).cast("int"))
    return found.withColumn("discovered_topic", F.col("_cluster")).select(*absent.columns).unionByName(absent)


def _nearest(centres: np.ndarray):
    """The number of the nearest centre, the first of equals."""

    @F.arrow_udf("int")
    def nearest(vectors: pa.Array) -> pa.Array:
        x = vectors.flatten().to_numpy(zero_copy_only=False).reshape(len(vectors), centres.shape[1])
        squares = (x * x).sum(1)[:, None] - 2 * (x @ centres.T) + (centres * centres).sum(1)
        return pa.array(squares.argmin(1).astype(np.int32))

    return nearest


def _moved_centres(training: DataFrame, k: int, rounds: int) -> np.ndarray:
    """Centres after ``rounds`` moves to the mean of their rows; a centre without rows stays."""
    first = training.orderBy("review_id").limit(k).collect()
    centres = np.array([row["_reduced"].toArray() for row in first])
    if not len(centres):
        raise ValueError("no vectors to fit")
    for _ in range(rounds):
        near = training.withColumn("_cluster", _nearest(centres)(vector_to_array("_reduced")))
        means = near.groupBy("_cluster").agg(Summarizer.mean(F.col("_reduced")).alias("mean")).collect()  # k rows
        for row in means:
            centres[row["_cluster"]] = row["mean"].toArray()
    return centres


def _narrow(reviews: DataFrame, embedding: str, *keep: str) -> DataFrame:
    """Only what fitting needs, for the rows with a finite vector: no text is cleaned for it."""
    return reviews.where(is_finite_vector(F.col(embedding))).select(
        *keep, array_to_vector(F.col(embedding)).alias("_vector")
    )


def pca_coordinates(
    reviews: DataFrame, embedding: str = "embedding", components: int = 2
) -> DataFrame:
    """Add ``pc1, pc2, ...``: the embedding in its first principal components, null without a finite one.

    Of each component the loading that is largest in size is positive, so signs are not arbitrary.
    """
    pca = PCA(k=components, inputCol="_vector", outputCol="_reduced").fit(_narrow(reviews, embedding))
    loadings = pca.pc.toArray()
    largest = np.abs(loadings).argmax(axis=0)
    axes = loadings * np.sign(loadings[largest, np.arange(loadings.shape[1])])
    vector = F.when(is_finite_vector(F.col(embedding)), F.col(embedding))

    def along(axis: np.ndarray):
        weights = F.array(*(F.lit(float(w)) for w in axis))
        return F.aggregate(F.zip_with(vector, weights, lambda v, w: v * w), F.lit(0.0), lambda total, v: total + v)

    return reviews.withColumns({f"pc{i + 1}": along(axes[:, i]) for i in range(axes.shape[1])})


def topic_keywords(
    assigned: DataFrame, top_n: int = 10, topic: str = "macro_topic"
) -> DataFrame:
    """Words that stand out in a topic: count times log(1 + words per topic / count overall)."""
    counted = tokens(assigned, [topic]).groupBy(topic, "word").agg(F.count(F.lit(1)).alias("n"))
    size = counted.groupBy(topic).agg(F.sum("n").alias("size"))
    average = size.agg(F.avg("size")).scalar()
    # One row per topic and word: a word's window holds at most one row per topic.
    overall = F.sum("n").over(Window.partitionBy("word"))
    scored = counted.withColumn("score", F.col("n") * F.log1p(average / overall))
    return top_words(scored, [topic], top_n, "score").select(topic, "rank", "word", "n", "score")
