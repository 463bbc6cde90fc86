import numpy as np
import pytest

from plaudit.constants import TOPIC_SEEDS
from plaudit.operators import discovery, models as M
from workloads.stubs import letter_encoder, vowel_classifier


def test_topic_seeds(spark):
    rows = M.topic_seeds(spark).collect()
    assert len({r.macro_topic for r in rows}) == 8
    assert {r.topic_id for r in rows if r.seed == "courier"} == {0}
    assert all(19 <= len(s) <= 26 for s in TOPIC_SEEDS.values())


def test_embed_texts_keeps_rows_and_order_of_batches(spark):
    texts = [None, "", "a e", "eee aa"] * 100
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").repartition(3)
    found = M.embed_texts(rows, "t", letter_encoder, batch_size=7).orderBy("i").collect()
    assert [list(r.embedding) for r in found] == letter_encoder()([t or "" for t in texts]).tolist()


def test_score_sentiment(spark):
    rows = spark.createDataFrame([(0, "eee"), (1, "aaa"), (2, "xyz")], "i int, t string")
    found = M.score_sentiment(rows, "t", vowel_classifier).orderBy("i").collect()
    assert [(r.sentiment, r.sentiment_num, r.sentiment_score) for r in found] == [
        ("positive", 1, 1.0), ("negative", -1, 1.0), ("neutral", 0, 0.5),
    ]


def test_blank_texts_are_scored_as_neutral(spark):
    def echo():
        return lambda texts: [{"label": t, "score": 1.0} for t in texts]

    rows = spark.createDataFrame([(0, " "), (1, None), (2, "Positive")], "i int, t string")
    found = M.score_sentiment(rows, "t", echo, batch_size=2).orderBy("i").collect()
    assert [(r.sentiment, r.sentiment_num) for r in found] == [
        ("neutral", 0), ("neutral", 0), ("positive", 1),
    ]


def test_unknown_label_has_no_number(spark):
    def factory():
        return lambda texts: [{"label": "LABEL_0", "score": 0.4} for _ in texts]

    rows = spark.createDataFrame([("x",)], "t string")
    (r,) = M.score_sentiment(rows, "t", factory).collect()
    assert (r.sentiment, r.sentiment_num) == ("label_0", None)


def test_model_runs_once_per_row_below_a_filter(spark):
    rows = spark.createDataFrame([("eee",), ("aaa",)], "t string")
    scored = M.score_sentiment(rows, "t", vowel_classifier).where("sentiment = 'positive'")
    assert scored.count() == 1
    plan = scored._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1


@pytest.fixture(scope="module")
def clustered(spark):
    rng = np.random.default_rng(4)
    centers = np.eye(3, 8) * 20
    data = [
        (i, bool(i % 5 == 0), (centers[i % 3] + rng.normal(size=8)).tolist()) for i in range(300)
    ]
    return spark.createDataFrame(data, "i int, is_target boolean, embedding array<double>")


def test_discover_topics_finds_separate_groups(clustered):
    found = discovery.discover_topics(clustered, k=3, components=3).collect()
    assert len(found) == 300
    assert len({(r.i % 3, r.discovered_topic) for r in found}) == 3
    with pytest.raises(ValueError):
        discovery.discover_topics(clustered, k=1)


def test_pca_explains_the_spread(clustered):
    found = discovery.pca_coordinates(clustered).orderBy("i").collect()
    x = np.array([r.embedding for r in found])
    xy = np.array([[r.pc1, r.pc2] for r in found])
    eigen = np.sort(np.linalg.eigvalsh(np.cov(x.T)))[::-1]
    assert np.allclose(np.var(xy, axis=0, ddof=1), eigen[:2])


def test_vectors_that_are_not_finite_are_none(spark):
    rng = np.random.default_rng(5)
    rows = [(i, i % 4 == 0, rng.normal(size=6).tolist()) for i in range(80)]
    odd = [None, [], [float("nan")] * 6, [1.0, None, 0.0, 0.0, 0.0, 0.0], [float("inf")] + [0.0] * 5]
    rows += [(100 + i, False, v) for i, v in enumerate(odd)]
    table = spark.createDataFrame(rows, "review_id int, is_target boolean, embedding array<double>")
    for rounds in (None, 3):
        found = {r.review_id: r.discovered_topic for r in discovery.discover_topics(table, 3, 2, rounds=rounds).collect()}
        assert len(found) == 85 and all((found[i] is None) == (i >= 100) for i in found)
    points = {r.review_id: r.pc1 for r in discovery.pca_coordinates(table).collect()}
    assert all((points[i] is None) == (i >= 100) for i in points)


def test_given_rounds_match_plain_k_means(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(120, 5)) * [5, 4, 3, 1, 1]
    target = np.arange(120) % 5 == 0
    table = spark.createDataFrame([(i, bool(t), v.tolist()) for i, (t, v) in enumerate(zip(target, x))], "review_id int, is_target boolean, embedding array<double>")
    found = discovery.discover_topics(table.repartition(4), 4, 3, rounds=5).orderBy("review_id").collect()
    fit = x[~target]
    _, axes = np.linalg.eigh(np.cov(fit.T))
    reduced = x @ axes[:, ::-1][:, :3]
    centres = reduced[~target][:4].copy()
    for _ in range(5):
        near = ((reduced[~target][:, None] - centres) ** 2).sum(2).argmin(1)
        for k in range(4):
            if (near == k).any():
                centres[k] = reduced[~target][near == k].mean(0)
    assert [r.discovered_topic for r in found] == ((reduced[:, None] - centres) ** 2).sum(2).argmin(1).tolist()
