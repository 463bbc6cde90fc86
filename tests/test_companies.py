import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from plaudit.operators import cleaning, companies as C

SCHEMA = "category string, company string, title string, review string, stars double"
ROWS = [
    ("x", "a", "good one", "one two three", 5.0),
    ("x", "a", "meh", "one", 3.0),
    ("x", "a", "", "one two", None),
    ("x", "b", "bad", "w " * 9, 1.0),
    ("x", "b", "half", "w w", 2.5),
    ("x", "c", None, None, 4.0),
    ("x", "d", "no stars", "w", None),
    ("y", "a", "other sector", "w w w w", 2.0),
    ("x", None, "nobody", "lost words here", 1.0),
    (None, "z", "no sector", "w", 1.0),
]


@pytest.fixture(scope="module")
def reviews(spark):
    return cleaning.add_length_features(spark.createDataFrame(ROWS, SCHEMA))


@pytest.fixture(scope="module")
def stats(reviews):
    return {(r.category, r.company): r for r in C.company_stats(reviews).collect()}


def test_company_stats_edges(stats):
    assert set(stats) == {("x", "a"), ("x", "b"), ("x", "c"), ("x", "d"), ("y", "a")}
    a = stats["x", "a"]
    assert (a.avg_stars, a.pct_positive, a.pct_neutral, a.pct_negative) == (4.0, 33.33, 33.33, 0.0)
    assert (a.avg_review_words, a.review_word_count, a.avg_title_words) == (2.0, 2.0, 1.0)
    assert (a.wc_positive, a.wc_neutral, a.wc_negative, a.review_count) == (3.0, 1.0, 0.0, 3)
    b = stats["x", "b"]
    assert (b.pct_positive, b.pct_neutral, b.pct_negative, b.wc_negative) == (0.0, 0.0, 50.0, 9.0)
    assert stats["x", "c"].review_count == 0 and stats["x", "c"].avg_review_words == 0.0
    assert stats["x", "d"].avg_stars is None and stats["x", "d"].pct_negative == 0.0


def test_ordered_puts_the_best_first_and_unrated_last(reviews):
    order = [(r.category, r.company) for r in C.company_stats(reviews, ordered=True).collect()]
    assert order == [("x", "a"), ("x", "c"), ("y", "a"), ("x", "b"), ("x", "d")]


def test_stats_do_not_depend_on_partitions(reviews):
    one, many = (
        sorted(map(str, C.company_stats(reviews.repartition(n)).collect())) for n in (1, 13)
    )
    assert one == many


def test_shares_of_whole_stars_sum_to_100(spark):
    rng = np.random.default_rng(1)
    rows = [("x", f"c{i % 7}", "t", "r", float(s)) for i, s in enumerate(rng.integers(1, 6, 500))]
    for r in C.company_stats(spark.createDataFrame(rows, SCHEMA)).collect():
        assert r.pct_positive + r.pct_neutral + r.pct_negative == pytest.approx(100, abs=0.02)


def test_overview(reviews):
    found = {r.column: r for r in C.dataset_overview(reviews).collect()}
    assert (found["title"].nulls, found["title"].empty_strings) == (1, 1)
    assert (found["review"].nulls, found["review"].empty_strings) == (1, 0)
    assert (found["stars"].nulls, found["stars"].empty_strings) == (2, 0)
    r = found["stars"]
    assert (r.total_reviews, r.unique_companies, r.min_stars, r.max_stars) == (10, 5, 1, 5)


def test_describe_equals_pandas(spark):
    rng = np.random.default_rng(5)
    pdf = pd.DataFrame({"k": rng.choice(["a", "b"], 300), "v": rng.normal(size=300).round(3)})
    pdf.loc[::17, "v"] = np.nan
    df = spark.createDataFrame(pdf).withColumn("v", F.nanvl("v", F.lit(None)))
    expected = pdf.groupby("k")["v"].describe()
    for r in C.describe(df, ["v"], ["k"]).collect():
        e = expected.loc[r.k]
        assert [r["count"], r["mean"], r["std"], r["min"], r["p25"], r["p50"], r["p75"], r["max"]] == (
            pytest.approx(e.tolist())
        )


def test_top_and_bottom_overlap_in_a_small_sector(reviews):
    shown = C.top_bottom_companies(C.company_stats(reviews), 3).where("category = 'x'").collect()
    sides = {side: [r.company for r in sorted(shown, key=lambda r: r.position) if r.side == side]
             for side in ("top", "bottom")}
    assert sides == {"top": ["a", "c", "b"], "bottom": ["d", "b", "c"]}
    assert {r.side: round(r.side_mean, 4) for r in shown} == {"top": 3.25, "bottom": 2.875}


def test_top_n_is_cut_before_the_shuffle(reviews):
    plan = C.longest_reviews(C.company_stats(reviews))._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan


def test_companies_with_exactly_n_reviews(reviews):
    full = cleaning.companies_with_reviews(reviews, 2)
    assert [(r.company, r.n_reviews) for r in full.collect()] == [("b", 2)]
    assert cleaning.reviews_of_companies(reviews, full).count() == 2


def test_company_values(reviews):
    rows = cleaning.company_values(reviews, "title", company="a", category="x")
    assert sorted(r.title for r in rows.collect()) == ["", "good one", "meh"]
