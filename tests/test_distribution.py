import numpy as np
import pytest
from pyspark.sql import functions as F

from plaudit.operators import distribution as D


@pytest.fixture(scope="module")
def groups():
    rng = np.random.default_rng(3)
    # "hot" holds most rows and few distinct values; "wide" crosses many buckets.
    return {
        "hot": np.round(rng.exponential(30, 4000)),
        "wide": np.round(rng.normal(500, 4000, 900), 2),
        "tiny": np.array([7.0]),
        "flat": np.full(20, 3.25),
        "pair": np.array([1.0, 2.0]),
    }


@pytest.fixture(scope="module")
def rows(spark, groups):
    data = [(k, float(v)) for k, vs in groups.items() for v in vs] + [("hot", None), (None, 1.0)]
    return spark.createDataFrame(data, "k string, v double")


def test_ranks_count_what_is_strictly_below(rows, groups):
    found = D.ranked(D.frequencies(rows, ["k"], "v"), ["k"], "v").collect()
    assert len(found) == sum(len(np.unique(v)) for v in groups.values())
    for r in found:
        assert r.below == int((groups[r.k] < r.v).sum())
        assert r.n == int((groups[r.k] == r.v).sum())
        assert r.total == len(groups[r.k])


@pytest.mark.parametrize("partitions", [1, 7])
def test_quantiles_equal_numpy(rows, groups, partitions):
    points = {"a": 0.0, "b": 0.25, "c": 0.5, "d": 0.97, "e": 1.0}
    values = D.ranked(D.frequencies(rows.repartition(partitions), ["k"], "v"), ["k"], "v")
    for r in D.quantiles(values, ["k"], "v", points).collect():
        expected = np.quantile(groups[r.k], list(points.values()))
        assert np.allclose([r[p] for p in points], expected, rtol=1e-12, atol=1e-12)


def test_box_statistics(rows, groups):
    for r in D.box_statistics(rows, ["k"], "v").collect():
        v = groups[r.k]
        q1, median, q3 = np.quantile(v, [0.25, 0.5, 0.75])
        low, high = q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1)
        assert np.allclose([r.q1, r.median, r.q3], [q1, median, q3])
        assert r.whisker_low == pytest.approx(min(v[v >= low].min(), q1))
        assert r.whisker_high == pytest.approx(max(v[v <= high].max(), q3))
        assert r.n_outliers == int(((v < low) | (v > high)).sum())


@pytest.mark.parametrize("bins", [1, 10, 40])
def test_histogram_equals_numpy(rows, groups, bins):
    found = D.histogram(rows, ["k"], "v", bins).orderBy("k", "bin").collect()
    assert len(found) == bins * len(groups)
    for k, v in groups.items():
        counts, edges = np.histogram(v, bins=bins)
        density, _ = np.histogram(v, bins=bins, density=True)
        mine = [r for r in found if r.k == k]
        assert [r.n for r in mine] == counts.tolist()
        assert np.allclose([r.density for r in mine], density)
        assert np.allclose([r.bin_start for r in mine], edges[:-1])
        assert np.allclose([r.bin_end for r in mine], edges[1:])


def test_values_on_bin_edges(spark):
    values = [0.0, 0.1, 0.2, 0.3, 0.6, 0.7, 0.9, 1.0, 1.0]
    rows = spark.createDataFrame([("a", v) for v in values], "k string, v double")
    found = D.histogram(rows, ["k"], "v", 10).orderBy("bin").collect()
    assert [r.n for r in found] == np.histogram(values, bins=10)[0].tolist()


def test_shares_skip_nulls(spark):
    rows = spark.createDataFrame([("a", 1), ("a", 1), ("a", 2), ("a", None), ("b", 5)], "k string, s int")
    found = {(r.k, r.s): (r.n, r.pct) for r in D.shares(rows, ["k"], "s").collect()}
    assert found == {
        ("a", 1): (2, pytest.approx(200 / 3)), ("a", 2): (1, pytest.approx(100 / 3)), ("b", 5): (1, 100.0),
    }


def test_no_window_holds_a_whole_group(rows):
    """Windows run over buckets and inside buckets, after the rows have been counted."""
    plan = D.ranked(D.frequencies(rows, ["k"], "v"), ["k"], "v")._jdf.queryExecution()
    text = plan.optimizedPlan().toString()
    windows = [line for line in text.splitlines() if "Window [" in line]
    assert windows and all("bucket" in line for line in windows)


def test_values_in_a_narrow_range_spread_over_many_buckets(spark):
    from pyspark.sql import Window

    rows = spark.range(1_000_000).select((F.col("id") / 1_000_000).alias("v"), F.lit("k").alias("k"))
    ranks = D.ranked(D.frequencies(rows, ["k"], "v"), ["k"], "v")
    assert ranks.where("below <> round(v * 1000000)").count() == 0
    plan = ranks._jdf.queryExecution().toString()
    assert "hashpartitioning(k" in plan and "bucket" in plan
