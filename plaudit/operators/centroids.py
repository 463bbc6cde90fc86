"""Topic assignment to thousands of centroids by a two-level index, with the result of the dense way.

Centroids lie in groups, each around a direction and within an angle of it. The angle between a review and any
centroid of a group is at least its angle to the group's direction less the group's own, so a group whose
best possible cosine is below one already found cannot win, and its centroids are not looked at.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from plaudit.constants import OTHER_TOPIC, OTHER_TOPIC_ID, SIMILARITY_THRESHOLD
from plaudit.operators.topics import Topics
from plaudit.plans.session import ship_package

ROUNDS = 6
# Scores closer than this are equal, and the first centroid wins; bounds are widened by it.
SLACK = 1e-9
_BLOCK = 1 << 22


def _unit(rows: np.ndarray) -> np.ndarray:
    length = np.linalg.norm(rows, axis=1)
    return rows / np.where(length == 0, 1.0, length)[:, None]


@dataclass
class CentroidIndex:
    """Centroids of length 1, sorted by group; directions and angles of the groups."""

    order: np.ndarray  # of each sorted centroid, its place among the given ones
    unit: np.ndarray
    bounds: np.ndarray  # centroids of group g: bounds[g] to bounds[g + 1]
    directions: np.ndarray
    angles: np.ndarray

    @classmethod
    def of(cls, matrix: np.ndarray, groups: int | None = None, seed: int = 42) -> CentroidIndex:
        """Groups by spherical k-means on the driver, about the root of the number of centroids; ValueError if there are none."""
        if not len(matrix):
            raise ValueError("no centroids")
        unit = _unit(np.asarray(matrix, np.float64))
        groups = min(len(unit), groups or max(1, math.isqrt(len(unit))))
        directions = unit[np.random.default_rng(seed).choice(len(unit), groups, replace=False)]
        for _ in range(ROUNDS):
            of = (unit @ directions.T).argmax(1)
            sums = np.zeros_like(directions)
            np.add.at(sums, of, unit)
            directions = np.where(sums.any(1)[:, None], _unit(sums), directions)
        of = (unit @ directions.T).argmax(1)
        used, of = np.unique(of, return_inverse=True)
        directions = directions[used]
        order = np.argsort(of, kind="stable")
        cosine = np.clip((unit * directions[of]).sum(1), -1, 1)
        angles = np.zeros(len(used))
        np.maximum.at(angles, of, np.arccos(cosine))
        # A zero centroid has cosine 0 with everything, which no angle tells: its group is always looked at.
        zero = ~unit.any(1)
        angles[of[zero]] = np.pi
        bounds = np.concatenate(([0], np.cumsum(np.bincount(of, minlength=len(used)))))
        return cls(order, unit[order], bounds, directions, angles)

    def nearest(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """Of each row of length 1 (or 0) the first centroid of the largest cosine, the cosine, and how many products it took."""
        n, groups = len(rows), len(self.angles)
        angle = np.arccos(np.clip(rows @ self.directions.T, -1, 1))
        most = np.cos(np.maximum(angle - self.angles - SLACK, 0))
        best, place, products = np.full(n, -np.inf), np.full(n, len(self.order)), n * groups
        first = most.argmax(1)
        # The most promising group of each row first, then all that could still win.
        for only in (True, False):
            for g in range(groups):
                which = np.flatnonzero(first == g) if only else np.flatnonzero((first != g) & (most[:, g] >= best - SLACK))
                if not len(which):
                    continue
                some = slice(self.bounds[g], self.bounds[g + 1])
                scores = rows[which] @ self.unit[some].T
                products += scores.size
                top = scores.max(1)
                equal = np.where(scores >= top[:, None] - SLACK / 1e3, self.order[some][None, :], len(self.order)).min(1)
                better = top > best[which] + SLACK / 1e3
                same = ~better & (top >= best[which] - SLACK / 1e3) & (equal < place[which])
                change = better | same
                best[which[change]] = np.where(better, top, np.maximum(top, best[which]))[change]
                place[which[change]] = equal[change]
        return place, best, products


def assign_by_index(
    reviews: DataFrame, topics: Topics, threshold: float = SIMILARITY_THRESHOLD, embedding: str = "embedding", groups: int | None = None,
) -> DataFrame:
    """:func:`plaudit.operators.topics.assign_topics` for many centroids: adds ``topic_id, macro_topic, topic_similarity``.

    The index is held by every worker, so the centroids must fit there; names travel as values, not as
    literals of the plan. Row-wise: no shuffle.
    """
    spark = reviews.sparkSession
    ship_package(spark)
    held = spark.sparkContext.broadcast((CentroidIndex.of(topics.matrix, groups), np.array(topics.ids), topics.names))
    width = topics.matrix.shape[1]

    @F.arrow_udf(T.StructType([
        T.StructField("id", T.IntegerType()), T.StructField("name", T.StringType()), T.StructField("similarity", T.DoubleType()),
    ]))
    def best(vectors: pa.Array) -> pa.Array:
        index, ids, names = held.value
        present = np.flatnonzero(vectors.is_valid().to_numpy(zero_copy_only=False))
        flat = vectors.drop_null().flatten().to_numpy(zero_copy_only=False).astype(np.float64)
        if flat.size != present.size * width:
            raise ValueError(f"every embedding must have {width} values, as the centroids do")
        rows = flat.reshape(-1, width)
        found = np.full(len(vectors), OTHER_TOPIC_ID, np.int32)
        name = [OTHER_TOPIC] * len(vectors)
        similarity, missing = np.zeros(len(vectors)), np.ones(len(vectors), bool)
        finite = np.isfinite(rows).all(1)
        step = max(1, _BLOCK // max(width, len(index.angles)))
        for start in range(0, int(finite.sum()), step):
            some = np.flatnonzero(finite)[start : start + step]
            place, score, _ = index.nearest(_unit(rows[some]))
            at = present[some]
            similarity[at], missing[at] = score, False
            for k, p, s in zip(at.tolist(), place.tolist(), score.tolist(), strict=True):
                if s >= threshold:
                    found[k], name[k] = ids[p], names[p]
        return pa.StructArray.from_arrays(
            [pa.array(found), pa.array(name), pa.array(similarity, mask=missing)], names=["id", "name", "similarity"]
        )

    return (
        reviews.withColumn("_best", best.asNondeterministic()(F.col(embedding)))  # one call per row
        .withColumns({"topic_id": F.col("_best.id"), "macro_topic": F.col("_best.name"), "topic_similarity": F.col("_best.similarity")})
        .drop("_best")
    )
