import numpy as np
import pytest
from pyspark.sql import functions as F

from plaudit.constants import OTHER_TOPIC
from plaudit.operators import topics as T

AXES = T.Topics([0, 1, 2], ["x", "y", "diagonal"], np.array([[2.0, 0], [0, 1], [1, 1]]))


def assign(spark, vectors, topics=AXES, **kwargs):
    rows = spark.createDataFrame(list(enumerate(vectors)), "i int, embedding array<float>")
    return T.assign_topics(rows, topics, **kwargs).orderBy("i").collect()


def test_closest_centroid_wins(spark):
    found = assign(spark, [[1.0, 0.0], [0.0, 9.0], [1.0, 1.0], [-1.0, -1.0], [0.0, 0.0], None])
    assert [r.topic_id for r in found] == [0, 1, 2, -1, -1, -1]
    assert [r.macro_topic for r in found] == ["x", "y", "diagonal", OTHER_TOPIC, OTHER_TOPIC, OTHER_TOPIC]
    assert [r.topic_similarity for r in found[:3]] == pytest.approx([1, 1, 1])
    assert found[3].topic_similarity == pytest.approx(-np.sqrt(0.5))  # best score, though below
    assert found[4].topic_similarity == 0.0 and found[5].topic_similarity is None


def test_threshold_itself_is_enough(spark):
    topics = T.Topics([7], ["only"], np.array([[1.0, 0.0]]))
    vectors = [[3.0, 4.0], [0.0, 1.0]]
    assert [r.topic_id for r in assign(spark, vectors, topics, threshold=0.6)] == [7, -1]
    assert [r.topic_id for r in assign(spark, vectors, topics, threshold=0.6000001)] == [-1, -1]
    assert [r.topic_id for r in assign(spark, [[0.0, 0.0]], topics, threshold=0.0)] == [7]


def test_first_topic_wins_a_tie(spark):
    twins = T.Topics([0, 1], ["first", "second"], np.array([[1.0, 0.0], [2.0, 0.0]]))
    assert assign(spark, [[5.0, 0.0]], twins)[0].macro_topic == "first"


def test_many_topics_and_scaling(spark):
    rng = np.random.default_rng(2)
    matrix, vectors = rng.normal(size=(90, 16)), rng.normal(size=(300, 16)).astype(np.float32)
    topics = T.Topics(list(range(90)), [f"t{i}" for i in range(90)], matrix)
    cosine = (vectors / np.linalg.norm(vectors, axis=1, keepdims=True)) @ (
        matrix / np.linalg.norm(matrix, axis=1, keepdims=True)
    ).T
    found = assign(spark, vectors.tolist(), topics)
    assert [r.topic_id for r in found] == cosine.argmax(axis=1).tolist()
    assert np.allclose([r.topic_similarity for r in found], cosine.max(axis=1), atol=1e-6)
    scaled = assign(spark, (vectors * 8).tolist(), topics)
    assert [r.topic_id for r in scaled] == [r.topic_id for r in found]


def test_wrong_width_is_an_error(spark):
    with pytest.raises(Exception, match="must have 2 values"):
        assign(spark, [[1.0, 2.0, 3.0]])


def test_seed_centroids_are_plain_means(spark):
    seeds = spark.createDataFrame(
        [(0, "a", [1.0, 3.0]), (0, "a", [3.0, 5.0]), (1, "b", [0.5, 0.0]), (1, "b", None)],
        "topic_id int, macro_topic string, embedding array<float>",
    )
    topics = T.collect_topics(T.seed_centroids(seeds))
    assert topics.names == ["a", "b"] and topics.matrix.tolist() == [[2.0, 4.0], [0.5, 0.0]]
    with pytest.raises(ValueError, match="no topic"):
        T.collect_topics(T.seed_centroids(seeds.limit(0)))


def test_split_target(spark):
    rows = spark.createDataFrame(
        [("a", "text"), ("b", "text"), (None, "text"), ("a", "  "), ("b", None), ("b", "")],
        "company string, review string",
    )
    found = T.split_target(rows, "a").collect()
    assert sorted((r.company or "", r.is_target) for r in found) == [
        ("", False), ("a", True), ("b", False),
    ]
    with pytest.raises(ValueError, match="not found"):
        T.split_target(rows, "c")


def test_distribution_of_empty_input(spark):
    rows = spark.createDataFrame([], "is_target boolean, macro_topic string")
    assert T.assignment_distribution(rows).count() == 0


def test_assignment_is_row_wise(spark):
    rows = spark.range(10).select(F.array(F.lit(1.0).cast("float"), F.lit(0.0).cast("float")).alias("embedding"))
    plan = T.assign_topics(rows, AXES)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_vectors_that_are_not_finite_count_as_none(spark):
    bad = [[float("nan"), 1.0], [float("inf"), 1.0], [None, 1.0], [None, None], [float("-inf"), float("nan")]]
    found = assign(spark, [*bad, [1.0, 0.0]])
    assert [(r.topic_id, r.topic_similarity) for r in found[:5]] == [(-1, None)] * 5
    assert found[5].topic_id == 0
    rows = spark.createDataFrame(list(enumerate([*bad, [1.0, 0.0]])), "i int, embedding array<float>")
    (mean,) = T.assign_topics(rows, AXES).agg(F.avg("topic_similarity")).first()
    assert mean == pytest.approx(1.0)
