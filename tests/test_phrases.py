"""Frequent runs, key phrases and quantile sketches."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from plaudit.operators import distribution, phrases as P, sketches as S


def reviews(spark, rows):
    return spark.createDataFrame(rows, "macro_topic string, review string, run string").repartition(3)


def texts(n=200, rng=random.Random(3)):
    words = ["late", "delivery", "was", "the", "parcel", "never", "a", "came", "back"]
    rows = [(f"t{i % 3}", " ".join(rng.choice(words) + rng.choice(["", "", ".", ",", " 12", " x1"]) for _ in range(rng.randint(0, 14))), "x") for i in range(n)]
    rows += [("t0", "Customer service never called back!", "x")] * 15 + [("t1", "customer SERVICE is kind", "x")] * 12
    return rows + [("t1", None, "x"), (None, "customer service", "x"), ("t2", "", "x"), ("t2", "été Été", "x")]


def brute_runs(rows, most, least):
    counts, total = Counter(), Counter()
    for topic, text, _ in rows:
        tokens = [w.strip(".,!?:;\"'") for w in (text or "").lower().split()]
        for i in range(len(tokens)):
            for size in range(1, most + 1):
                run = tokens[i : i + size]
                if len(run) == size and all(w.isalpha() for w in run):
                    counts[topic, " ".join(run), size] += 1
                    total[" ".join(run)] += 1
    return {k: n for k, n in counts.items() if total[k[1]] >= least}


@pytest.mark.parametrize("most, least", [(1, 1), (4, 10), (6, 2)])
def test_runs_are_those_of_brute_force(spark, most, least):
    rows = texts()
    found = {(r.macro_topic, r.run, r.n_words): r.n for r in P.frequent_runs(reviews(spark, rows), most, least).collect()}
    assert found == brute_runs(rows, most, least)


def test_places_are_not_written(spark, monkeypatch):
    sizes, keep = [], P.durable

    def noted(df, name):
        table = keep(df, name)
        sizes.append(table.count())
        return table

    monkeypatch.setattr(P, "durable", noted)
    rows = [(f"t{i % 3}", "the late parcel never came back to the late customer", "x") for i in range(120)]
    assert P.frequent_runs(reviews(spark, rows), 4, 10).count() > 0
    assert max(sizes) <= len(rows)  # there are ten places in every text


def test_runs_of_nothing(spark):
    assert P.frequent_runs(reviews(spark, [])).count() == 0
    assert P.phrase_scores(P.frequent_runs(reviews(spark, [("t", "one", "x")]))).count() == 0
    with pytest.raises(ValueError):
        P.frequent_runs(reviews(spark, []), 0)


def test_scores_match_the_formula_and_unlike_phrases_are_chosen(spark):
    rows = texts()
    runs = P.frequent_runs(reviews(spark, rows), 4, 5)
    held = brute_runs(rows, 4, 5)
    scores = {(r.macro_topic, r.run): r for r in P.phrase_scores(runs).collect()}
    size = Counter()
    for (topic, _, words), n in held.items():
        size[topic, words] += n
    for (topic, run), r in scores.items():
        n = held[topic, run, r.n_words]
        every = sum(v for (t, x, _), v in held.items() if x == run)
        total = sum(v for (t, w), v in size.items() if w == r.n_words)
        inside, outside = size[topic, r.n_words], total - size[topic, r.n_words]
        want = 2 * (n * math.log(n / (every / total * inside)) + ((every - n) * math.log((every - n) / (every / total * outside)) if every > n else 0))
        assert (r.n, r.n_all) == (n, every) and r.g2 == pytest.approx(want) and n / inside > (every - n) / max(outside, 1e-9)
    assert not any(run.split()[0] in ("the", "a", "was") or run.split()[-1] in ("the", "a") for _, run in scores)
    ranked = P.ranked_phrases(P.phrase_scores(runs), 50)
    chosen = P.unlike_phrases(ranked, 4).collect()
    by_topic = {}
    for r in sorted(chosen, key=lambda r: (r.macro_topic or "", r.place)):
        by_topic.setdefault(r.macro_topic, []).append(set(r.run.split()))
    for own in by_topic.values():
        assert len(own) <= 4
        assert all(len(a & b) <= 0.5 * len(a | b) for i, a in enumerate(own) for b in own[:i])
    best = {r.macro_topic: r.run for r in ranked.where("rank = 1").collect()}
    assert all({r.macro_topic: r.run for r in chosen if r.place == 1}[t] == run for t, run in best.items())


# --- sketches --------------------------------------------------------------------------------------


def test_sketches_add_up_and_their_rank_error_is_small(spark, rng=np.random.default_rng(5)):
    values = np.r_[rng.lognormal(3, 1.5, 60_000), np.full(20_000, 7.0), rng.normal(900, 1, 20_000)]
    rows = spark.createDataFrame([(f"c{i % 40 if i % 3 else 0}", "ab"[i % 2], float(v)) for i, v in enumerate(values)], "company string, category string, v double").repartition(8)
    kept = S.quantile_sketches(rows, ["category", "company"], "v")
    merged = S.merge_sketches(kept, ["category"])
    points = {f"p{p}": p / 100 for p in (1, 10, 25, 50, 75, 90, 97, 99)}
    found = {r.category: r for r in S.sketched_quantiles(merged, {"least": 0, **points, "most": 1}).collect()}
    for side in "ab":
        own = np.sort(values["ab".index(side)::2])
        assert found[side].n == len(own) and (found[side].least, found[side].most) == (own[0], own[-1])
        for name, p in points.items():
            low, high = np.searchsorted(own, found[side][name], "left") / len(own), np.searchsorted(own, found[side][name], "right") / len(own)
            assert low - 0.003 <= p <= high + 0.003, (name, low, high)
    share = merged.select(S.sketched_rank(merged, F.lit(7.0)).alias("r")).first()["r"]
    assert abs(share - (values[::2] <= 7).mean()) < 0.01


def test_small_groups_are_exact(spark):
    rows = spark.createDataFrame([(None if i % 9 == 0 else "a", None if i % 5 == 0 else i) for i in range(300)], "k string, v int")
    found = {r.k: r for r in S.sketched_quantiles(S.merge_sketches(S.quantile_sketches(rows, ["k", "v"], "v"), ["k"]), {"p": 0.5}).collect()}
    own = sorted(i for i in range(300) if i % 5 and i % 9)
    assert found["a"].n == len(own) and found["a"].p == own[math.ceil(len(own) / 2) - 1]
    assert S.quantile_sketches(rows.where("v < 0"), ["k"], "v").count() == 0


# --- ranks of long-tailed values -------------------------------------------------------------------


@pytest.mark.parametrize("outlier", [1e12, -1e12, 2.0])
def test_an_outlier_does_not_fill_one_bucket(spark, outlier):
    rows = spark.range(200_000).select(F.lit("g").alias("k"), (F.xxhash64("id") / 2.0**64 + 0.5).alias("v")).unionByName(
        spark.createDataFrame([("g", outlier)], "k string, v double")
    )
    values = distribution.ranked(distribution.frequencies(rows, ["k"], "v"), ["k"], "v")
    assert values.where("below < 0 or total <> 200001").isEmpty()
    exact = np.sort(np.r_[[r.v for r in rows.collect()]])
    for r in values.sample(0.002, 1).collect():
        assert r.below == np.searchsorted(exact, r.v)
    low, high = (F.col("v") - float(exact[0])) / float(exact[-1] - exact[0]), (float(exact[-1]) - F.col("v")) / float(exact[-1] - exact[0])

    def log(share):
        return F.log1p(share * distribution._STEPS) / F.log1p(F.lit(distribution._STEPS))

    sizes = rows.groupBy(F.floor((low + log(low) + 1 - log(high)) / 3 * distribution.BUCKETS)).count()
    assert sizes.agg(F.max("count")).first()[0] < 200_000 / 20
