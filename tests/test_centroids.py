"""The centroid index against the dense way."""

import numpy as np
import pytest

from plaudit.operators import centroids as C, topics as T


def clouds(rng, n, width=24, around=60, spread=0.15):
    centres = rng.normal(size=(around, width))
    return centres[rng.integers(0, around, n)] + rng.normal(size=(n, width)) * spread


@pytest.mark.parametrize("groups", [None, 1, 5, 2000])
def test_the_index_finds_what_all_products_find(groups, rng=np.random.default_rng(1)):
    matrix = np.r_[clouds(rng, 1500), np.zeros((1, 24)), rng.normal(size=(300, 24))]
    matrix = np.r_[matrix, matrix[:40] * 3]  # the same directions again: the first wins
    rows = np.r_[clouds(rng, 800), rng.normal(size=(200, 24)), np.zeros((2, 24)), matrix[:50], -matrix[:50]]
    unit, rows = C._unit(matrix), C._unit(rows)
    scores = rows @ unit.T
    place, best, products = C.CentroidIndex.of(matrix, groups).nearest(rows)
    assert np.abs(best - scores.max(1)).max() < 1e-12
    first = (scores >= scores.max(1)[:, None] - 1e-12).argmax(1)
    assert (place == first).all()


def test_far_fewer_products_where_topics_lie_in_groups(rng=np.random.default_rng(2)):
    matrix = clouds(rng, 4000, width=48, around=64)
    rows = C._unit(np.r_[matrix[rng.integers(0, 4000, 2000)] + rng.normal(size=(2000, 48)) * 0.1])
    place, best, products = C.CentroidIndex.of(matrix).nearest(rows)
    assert (place == (rows @ C._unit(matrix).T).argmax(1)).mean() > 0.999
    assert products < len(rows) * len(matrix) / 5


def test_assignment_is_that_of_the_dense_way(spark, rng=np.random.default_rng(3)):
    matrix = clouds(rng, 300, width=12)
    topics = T.Topics(list(range(100, 400)), [f"t{i}" for i in range(300)], matrix)
    vectors = [v.tolist() for v in np.r_[clouds(rng, 500, width=12), rng.normal(size=(100, 12))].astype(np.float32)]
    vectors += [None, [0.0] * 12, [float("nan")] * 12, [None] + [1.0] * 11]
    rows = spark.createDataFrame(list(enumerate(vectors)), "i int, embedding array<float>").repartition(4)
    dense = T.assign_topics(rows, topics, 0.4).orderBy("i").collect()
    found = C.assign_by_index(rows, topics, 0.4).orderBy("i").collect()
    for a, b in zip(dense, found, strict=True):
        assert (a.topic_id, a.macro_topic) == (b.topic_id, b.macro_topic)
        assert (a.topic_similarity is None) == (b.topic_similarity is None)
        assert a.topic_similarity is None or a.topic_similarity == pytest.approx(b.topic_similarity, abs=1e-12)
    with pytest.raises(ValueError):
        C.CentroidIndex.of(np.zeros((0, 3)))
    with pytest.raises(Exception):
        C.assign_by_index(rows.limit(3), T.Topics([1], ["x"], np.ones((1, 5)))).collect()
