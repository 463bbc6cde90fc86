import numpy as np
import pandas as pd
import pytest

from plaudit.operators import positioning as P

COLUMNS = ["avg_stars", "pct_positive", "pct_neutral", "pct_negative",
           "wc_negative", "wc_neutral", "wc_positive"]


@pytest.fixture(scope="module")
def pdf():
    rng = np.random.default_rng(9)
    n = 400
    frame = pd.DataFrame({"category": rng.choice(["big", "small"], n, p=[0.9, 0.1])})
    frame["company"] = [f"c{i:03}" for i in range(n)]
    # A third of all companies share one rating.
    frame["avg_stars"] = np.where(rng.random(n) < 0.34, 5.0, rng.uniform(1, 5, n)).round(2)
    for c in COLUMNS[1:]:
        frame[c] = rng.uniform(0, 100 if c.startswith("pct") else 300, n).round(2)
    frame.loc[frame.sample(20, random_state=1).index, "avg_stars"] = np.nan
    frame.loc[0, "avg_stars"], frame.loc[0, "category"] = 5.0, "big"
    alone = pd.DataFrame([{"category": "alone", "company": "only", **dict.fromkeys(COLUMNS, 3.0)}])
    return pd.concat([frame, alone], ignore_index=True)


@pytest.fixture(scope="module")
def stats(spark, pdf):
    schema = "category string, company string, " + ", ".join(f"{c} double" for c in COLUMNS)
    rows = [tuple(None if pd.isna(v) else v for v in r) for r in pdf[["category", "company", *COLUMNS]].values]
    return spark.createDataFrame(rows, schema)


TARGET = "c000"


def sector(pdf):
    mine = pdf[pdf.company == TARGET].iloc[0]
    return mine, pdf[(pdf.category == mine.category) & (pdf.company != TARGET)]


def test_percentile_ranks_of_all_companies(stats, pdf):
    found = P.percentile_ranks(stats).collect()
    assert len(found) == int(pdf[list(P.KPIS)].notna().sum().sum())
    by_sector = {k: g for k, g in pdf.groupby("category")}
    for r in found:
        values = by_sector[r.category][r.metric].dropna()
        if len(values) == 1:
            assert r.percentile is None
        else:
            assert r.percentile == pytest.approx((values < r.value).sum() / (len(values) - 1) * 100)
            assert 0 <= r.percentile <= 100


def test_percentile_dashboard(stats, pdf):
    mine, others = sector(pdf)
    found = P.percentile_dashboard(stats, TARGET).collect()
    assert {(r.category, r.metric) for r in found} == {("big", m) for m in P.KPIS}
    for r in found:
        values = others[r.metric].dropna()
        assert r.target_value == mine[r.metric] and r.n_competitors == len(values)
        assert r["median"] == pytest.approx(values.median())
        assert r.percentile == pytest.approx((values < mine[r.metric]).mean() * 100)


def test_stars_positioning_counts_unrated_competitors(stats, pdf):
    mine, others = sector(pdf)
    (r,) = P.stars_positioning(stats, TARGET).collect()
    assert others.avg_stars.isna().any() and r.n_competitors == len(others)
    assert r.percentile == pytest.approx((others.avg_stars < mine.avg_stars).mean() * 100)
    assert r.sector_median == pytest.approx(others.avg_stars.median())


def test_a_sector_of_one(stats):
    (r,) = P.stars_positioning(stats, "only").collect()
    assert (r.target_value, r.sector_median, r.percentile, r.n_competitors) == (3.0, None, None, 0)


def test_absent_target_gives_no_rows(stats):
    assert P.percentile_dashboard(stats, "nobody").count() == 0
    assert P.sentiment_split(stats, "nobody").count() == 0


def test_word_count_positioning(stats, pdf):
    mine, others = sector(pdf)
    found = {r.metric: r for r in P.word_count_positioning(stats, TARGET).collect()}
    assert set(found) == set(P.WORD_TIERS)
    for metric, r in found.items():
        v = others[metric].to_numpy()
        q1, median, q3 = np.quantile(v, [0.25, 0.5, 0.75])
        assert (r.q1, r["median"], r.q3) == (pytest.approx(q1), pytest.approx(median), pytest.approx(q3))
        assert r.percentile == pytest.approx((v < mine[metric]).mean() * 100)
        assert r.whisker_low == pytest.approx(v[v >= q1 - 1.5 * (q3 - q1)].min())


def test_sentiment_split(stats, pdf):
    _, others = sector(pdf)
    found = {r.position: r for r in P.sentiment_split(stats, TARGET).collect()}
    assert set(found) == {
        "target", "median", "best", "worst"
    }
    rated = others.dropna(subset=["avg_stars"])
    best = rated[rated.avg_stars == rated.avg_stars.max()].company.min()
    worst = rated[rated.avg_stars == rated.avg_stars.min()].company.min()
    assert (found["best"].company, found["worst"].company) == (best, worst)
    assert found["best"].label == "Best (★ 5.00)"
    for c in P.SPLIT:
        assert found["median"][c] == pytest.approx(others[c].median())


def test_star_histogram_and_density(stats, pdf):
    _, others = sector(pdf)
    values = others.avg_stars.dropna().to_numpy()
    counts, _ = np.histogram(values, bins=10)
    found = P.stars_histogram(stats, TARGET).where("category = 'big'").orderBy("bin").collect()
    assert [r.n for r in found] == counts.tolist()
    grid = P.star_density(stats, TARGET, grid_points=50).where("category = 'big'").orderBy("point").collect()
    bw = values.std(ddof=1) * len(values) ** -0.2
    for r in grid:
        z = (r.avg_stars - values) / bw
        expected = np.exp(-0.5 * z * z).mean() / (bw * np.sqrt(2 * np.pi))
        assert r.density == pytest.approx(expected)


def test_stats_are_aggregated_once(spark, stats, tmp_path):
    """All branches of a plan share the aggregation of the reviews."""
    from plaudit.operators.companies import company_stats

    path = str(tmp_path / "reviews")
    spark.range(100).selectExpr(
        "'x' AS category", "concat('c', id % 9) AS company", "'t t' AS title", "'w w' AS review",
        "cast(id % 5 + 1 AS int) AS stars",
    ).write.parquet(path)
    for build in (P.percentile_ranks, lambda s: P.sentiment_split(s, "c1"),
                  lambda s: P.word_count_positioning(s, "c1")):
        df = build(company_stats(spark.read.parquet(path)))
        df.collect()
        plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
        assert plan.count("FileScan") == 1
