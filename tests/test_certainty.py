"""Poisson bootstrap and log-odds of words."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from plaudit.operators import certainty as C, compare, wordodds as W


def assembled(spark, rows):
    full = [(i, t, topic, s, 0.5, text) for i, t, topic, s, text in rows]
    return spark.createDataFrame(full, "review_id long, is_target boolean, macro_topic string, sentiment string, topic_similarity double, review string").repartition(3)


def mixed(rng, n, share, is_target, topic, first=0):
    return [(first + i, is_target, topic, "positive" if rng.random() < share else "negative", "x") for i in range(n)]


def python_hash(i, b):
    m = C.MODULUS
    x = ((-1 if i is None else i) % m * C.MULTIPLIERS[0] + b * C.MULTIPLIERS[2] + 1) % m
    for shift in (13, 17):
        x = (x ^ (x >> shift)) * C.MULTIPLIERS[1] % m
    return (x ^ (x >> 15)) % m


def weight(h):
    return sum(h >= t for t in C.poisson_thresholds())


def test_weights_are_poisson_and_independent(spark):
    ids = [None, -5, 0, 1, 2**40, *range(10, 3000)]
    rows = spark.createDataFrame([(i,) for i in ids], "i long").select("i", F.explode(F.sequence(F.lit(0), F.lit(19))).alias("b"))
    found = rows.withColumn("h", C.hashed(F.col("i"), F.col("b"))).withColumn("w", C.poisson_weight(F.col("h"))).collect()
    assert all(r.h == python_hash(r.i, r.b) and r.w == weight(r.h) for r in found)
    w = np.array([r.w for r in sorted(found, key=lambda r: (r.i is not None, r.i or 0, r.b))]).reshape(-1, 20)
    assert abs(w.mean() - 1) < 0.02 and abs(w.var() - 1) < 0.04
    assert [abs((w == k).mean() - math.exp(-1) / math.factorial(k)) < 0.01 for k in range(4)] == [True] * 4
    between = np.corrcoef(w.T) - np.eye(20)
    assert np.abs(between).max() < 0.1  # replicates
    assert abs(np.corrcoef(w[5:-1].reshape(-1), w[6:].reshape(-1))[0, 1]) < 0.02  # neighbouring ids


def test_bounds_match_a_plain_bootstrap(spark, rng=random.Random(4)):
    rows = mixed(rng, 60, 0.4, True, "a") + mixed(rng, 300, 0.7, False, "a", 100) + mixed(rng, 3, 0.5, True, "b", 500) + mixed(rng, 5, 0.5, False, "b", 600)
    rows += [(900, True, "General / Other", "positive", "x"), (901, True, "own", "positive", "x")]
    table = assembled(spark, rows)
    found = {r.macro_topic: r for r in C.gap_bounds(table, compare.head_to_head(compare.topic_summary(table)), 150).collect()}
    assert set(found) == {"a", "b"}
    for topic in found:
        gaps = []
        for b in range(150):
            net = {}
            for side in (True, False):
                own = [(weight(python_hash(i, b)), 1 if s == "positive" else -1) for i, t, name, s, _ in rows if t == side and name == topic]
                total = sum(w for w, _ in own)
                net[side] = 100 * sum(w * s for w, s in own) / total if total else None
            if None not in net.values():
                gaps.append(net[True] - net[False])
        r = found[topic]
        assert r.n_replicates == len(gaps)
        assert np.allclose([r.gap_low, r.gap_high], np.quantile(gaps, [0.025, 0.975]))
        assert r.share_below == pytest.approx(np.mean(np.array(gaps) < 0))
    assert found["a"].gap_low < found["a"].gap < found["a"].gap_high
    weak = C.certainly_weak(C.gap_bounds(table, compare.head_to_head(compare.topic_summary(table)), 150))
    assert [r.macro_topic for r in weak.collect()] == ["a"]
    lists = {r.macro_topic: r.list for r in C.certain_strengths_weaknesses(spark.createDataFrame(list(found.values()))).collect()}
    assert lists == {"a": "weakness", "b": "undecided"}


def test_intervals_hold_the_truth_as_often_as_they_say(spark, rng=random.Random(9)):
    rows, k = [], 0
    for topic in range(120):
        rows += mixed(rng, 80, 0.5, True, f"t{topic}", k) + mixed(rng, 200, 0.6, False, f"t{topic}", k + 1000)
        k += 5000
    table = assembled(spark, rows)
    found = C.gap_bounds(table, compare.head_to_head(compare.topic_summary(table))).collect()
    inside = np.mean([r.gap_low <= -20 <= r.gap_high for r in found])  # the true gap: 0 - 20
    assert 0.88 <= inside <= 1


def test_more_reviews_make_narrower_bounds_in_one_pass(spark, rng=random.Random(2)):
    rows = mixed(rng, 50, 0.5, True, "few") + mixed(rng, 50, 0.5, False, "few", 100) + mixed(rng, 2000, 0.5, True, "many", 1000) + mixed(rng, 2000, 0.5, False, "many", 9000)
    table = assembled(spark, rows)
    r = {x.macro_topic: x for x in C.gap_bounds(table, compare.head_to_head(compare.topic_summary(table))).collect()}
    assert r["many"].gap_high - r["many"].gap_low < (r["few"].gap_high - r["few"].gap_low) / 3
    plan = C.replicate_gaps(table)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Generate explode") == 1 and "Join" not in plan


def test_bounds_of_nothing(spark):
    table = assembled(spark, [])
    assert C.gap_bounds(table, compare.head_to_head(compare.topic_summary(table))).count() == 0
    with pytest.raises(ValueError):
        C.replicate_gaps(table, 0)


# --- words -----------------------------------------------------------------------------------------


def texts():
    shared = "parcel delivery customer service"
    return [
        *((i, True, "a", "negative", f"{shared} refund refund broken") for i in range(20)),
        *((100 + i, False, "a", "negative", f"{shared} refund cheap cheap") for i in range(30)),
        *((200 + i, False, "a", "positive", f"{shared} lovely") for i in range(30)),
        (300, True, "b", "negative", "unique broken"), (301, False, "c", "negative", None), (302, False, "c", "negative", ""),
    ]


def test_word_odds_match_the_formula(spark):
    found = {(r.macro_topic, r.word): r for r in W.word_odds(assembled(spark, texts()), prior_words=50).collect()}
    words = {}
    for _, target, topic, sentiment, text in texts():
        for word in (text or "").split():
            words.setdefault((topic, word), []).append((target, sentiment))
    everything = sum(map(len, words.values()))

    def share(word):
        return 50 * sum(len(v) for (_, w), v in words.items() if w == word) / everything

    def size(topic, target):
        return sum(sum(u == (target, "negative") for u in v) for (t, _), v in words.items() if t == topic)

    want = {}
    for (topic, word), uses in words.items():
        n = [sum(u == (side, "negative") for u in uses) for side in (True, False)]
        if sum(n):
            a = share(word)
            odds = [math.log((k + a) / (size(topic, side) + 50 - k - a)) for k, side in zip(n, (True, False))]
            want[topic, word] = (*n, odds[0] - odds[1], (odds[0] - odds[1]) / math.sqrt(1 / (n[0] + a) + 1 / (n[1] + a)))
    assert set(found) == set(want)
    for key, values in want.items():
        assert np.allclose(found[key][2:], values)
    assert found["a", "broken"].z > 2 and found["a", "cheap"].z < -2 and abs(found["a", "parcel"].z) < 1.96


def test_distinctive_words(spark):
    odds = W.word_odds(assembled(spark, texts()))
    top = {(r.macro_topic, r.side, r.rank): r.word for r in W.distinctive_words(odds, 1, 1.0).collect()}
    assert top["a", "target", 1] == "broken" and top["a", "competitors", 1] == "cheap"
    assert W.word_odds(assembled(spark, [])).count() == 0
    with pytest.raises(ValueError):
        W.word_odds(assembled(spark, []), 0)


def test_one_use_does_not_stand_out(spark):
    rows = texts() + [(900, True, "a", "negative", "hapax")]
    found = {r.word: r.z for r in W.word_odds(assembled(spark, rows)).where("macro_topic = 'a'").collect()}
    assert 0 < found["hapax"] < 1.96 < found["broken"]
