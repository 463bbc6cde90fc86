import pytest

from plaudit.constants import OTHER_TOPIC
from plaudit.operators import compare as C, discovery, rootcause as R

SCHEMA = (
    "review_id long, is_target boolean, company string, macro_topic string, topic_similarity double,"
    " sentiment string, sentiment_score double, sentiment_num int, stars int, title string, review string"
)
NUMBER = {"positive": 1, "neutral": 0, "negative": -1}


def reviews(spark, spec):
    """``spec``: (is_target, topic, sentiment, how many, text)."""
    rows, i = [], 0
    for mine, topic, sentiment, times, text in spec:
        for _ in range(times):
            rows.append((i, mine, "me" if mine else "you", topic, 0.5, sentiment, 0.9,
                         NUMBER[sentiment], 2 + NUMBER[sentiment] - i % 2, "t", text))
            i += 1
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def assembled(spark):
    return reviews(spark, [
        (True, "price", "positive", 1, "cheap cheap"),
        (True, "price", "negative", 9, "Expensive! expensive, the ab1c price"),
        (True, "repair", "positive", 10, "works works works"),
        (True, "own", "neutral", 2, "plain"),
        (True, "few", "negative", 9, "broken broken"),
        (True, OTHER_TOPIC, "negative", 3, "whatever"),
        (False, "price", "positive", 1, "fair price"),
        (False, "price", "negative", 1, "costly costly price"),
        (False, "repair", "positive", 1, "works"),
        (False, "few", "positive", 4, "works"),
        (False, "theirs", "positive", 1, "shiny"),
        (False, "also theirs", "negative", 1, "dull dull"),
    ])


def test_summary(assembled):
    found = {(r.is_target, r.macro_topic): r for r in C.topic_summary(assembled).collect()}
    r = found[True, "price"]
    assert (r.n_reviews, r.pct_positive, r.pct_neutral, r.pct_negative) == (10, 10.0, 0.0, 90.0)
    assert (r.net_sentiment, r.dominant_sentiment, r.avg_similarity) == (-80.0, "negative", 0.5)
    assert found[False, "price"].dominant_sentiment == "positive"  # tie
    assert (True, OTHER_TOPIC) in found
    named = C.topic_summary(assembled, exclude_other=True)
    assert OTHER_TOPIC not in {r.macro_topic for r in named.collect()}
    best_first = [r.macro_topic for r in C.one_side(C.topic_summary(assembled), True).collect()]
    assert best_first == ["repair", "own", "price", OTHER_TOPIC, "few"]


def test_heatmap_order_and_gaps(assembled):
    found = C.topic_heatmap(C.topic_summary(assembled)).orderBy("position").collect()
    assert [r.macro_topic for r in found] == [
        "repair", "own", "price", OTHER_TOPIC, "few", "theirs", "also theirs",
    ]
    own = found[1]
    assert (own.pct_neutral_target, own.pct_positive_comp, own.pct_negative_comp) == (100.0, 0.0, 0.0)


def test_head_to_head_and_lists(assembled):
    merged = C.head_to_head(C.topic_summary(assembled))
    found = {r.macro_topic: r for r in merged.collect()}
    assert set(found) == {"price", "repair", "few"}
    assert (found["price"].gap, found["few"].gap, found["repair"].gap) == (-80.0, -200.0, 0.0)
    lists = [(r.list, r.rank, r.macro_topic, r.flag) for r in C.strengths_weaknesses(merged).collect()]
    assert lists == [
        ("priority", 1, "few", "red"), ("priority", 2, "price", "red"), ("priority", 3, "repair", "green"),
        ("weakness", 1, "few", None), ("weakness", 2, "price", None),
    ]
    assert [r.macro_topic for r in C.weak_topics(merged).collect()] == ["few", "price"]
    assert C.weak_topics(merged, min_gap=-200.0).count() == 0  # strict
    assert [r.macro_topic for r in C.weak_topics(merged, min_reviews=10).collect()] == ["price"]


def test_root_cause_honours_the_volume_floor(assembled):
    merged = C.head_to_head(C.topic_summary(assembled))
    report = R.root_cause(assembled, merged)
    assert [r.macro_topic for r in report.topics.collect()] == ["price"]
    negative = report.negative_reviews.collect()
    assert len(negative) == 9
    words = [(r.is_target, r.rank, r.word, r.n) for r in report.words.orderBy("is_target", "rank").collect()]
    assert words == [(False, 1, "costly", 2), (False, 2, "price", 1), (True, 1, "expensive", 18), (True, 2, "price", 9)]
    assert R.root_cause(assembled, merged, max_reviews=4).negative_reviews.count() == 4
    assert R.root_cause(assembled, merged, min_reviews=9).negative_reviews.count() == 18


def test_extract_reviews(assembled):
    assert R.extract_reviews(assembled, "price", "all").count() == 12
    assert R.extract_reviews(assembled, "own", "neutral").count() == 2
    assert R.extract_reviews(assembled.drop("title", "review_id"), "own", "all").columns == [
        "company", "stars", "macro_topic", "topic_similarity", "sentiment", "sentiment_score", "review",
    ]


def test_word_frequencies_cut_and_ties(spark):
    text = " ".join(f"word{chr(97 + i)}" for i in range(26))
    rows = reviews(spark, [(True, "t", "negative", 2, text), (True, "t", "positive", 1, "ignored")])
    found = R.word_frequencies(rows, 15).orderBy("rank").collect()
    assert [r.word for r in found] == [f"word{chr(97 + i)}" for i in range(15)]
    assert {r.n for r in found} == {2}


def test_words_and_tone(assembled):
    found = {(r.is_target, r.word): r for r in R.words_and_tone(assembled).collect()}
    assert found[False, "price"].n == 2 and found[False, "price"].avg_sentiment == 0.0
    assert found[True, "works"].n == 30 and found[True, "works"].avg_sentiment == 1.0


def test_topic_keywords(assembled):
    import math

    found = {(r.macro_topic, r.word): r for r in discovery.topic_keywords(assembled).collect()}
    from collections import Counter

    counts, topics = Counter(), Counter()
    for r in R.tokens(assembled, ["macro_topic"]).collect():
        counts[r.macro_topic, r.word] += 1
        topics[r.macro_topic] += 1
    average = sum(topics.values()) / len(topics)
    for (topic, word), r in found.items():
        overall = sum(n for (_, w), n in counts.items() if w == word)
        assert r.n == counts[topic, word]
        assert r.score == pytest.approx(counts[topic, word] * math.log(1 + average / overall))


def test_hot_words_are_cut_before_the_shuffle(assembled):
    plan = R.word_frequencies(assembled)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "partial_count" in plan
