from pyspark.sql import functions as F

from plaudit.functions import labels as L

STARS = [5.0, 4.0, 3.5, 3.0, 2.5, 2.0, 1.0, None]


def table(spark, column, values, kind):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, {column} {kind}")


def values(df, column):
    return [r[0] for r in df.orderBy("i").select(column).collect()]


def test_three_tier_rules_differ_where_they_should(spark):
    df = table(spark, "stars", STARS, "double")
    s = F.col("stars")
    tiers = L.stats_tiers(s)
    assert values(df, tiers["positive"]) == [True, True, False, False, False, False, False, None]
    assert values(df, tiers["neutral"]) == [False, False, False, True, False, False, False, None]
    assert values(df, tiers["negative"]) == [False, False, False, False, False, True, True, None]
    assert values(df, L.length_tier(s)) == [
        "Positive (4-5)", "Positive (4-5)", "Neutral (3)", "Neutral (3)", "Neutral (3)",
        "Negative (1-2)", "Negative (1-2)", "Neutral (3)",
    ]
    sentiment = L.star_sentiment(s)
    assert values(df, sentiment["sentiment_num"]) == [1, 1, -1, 0, -1, -1, -1, -1]
    assert values(df, sentiment["sentiment_score"]) == [0.95, 0.95, 0.95, 0.7, 0.95, 0.95, 0.95, 0.95]


def test_sentiment_number(spark):
    df = table(spark, "label", ["Positive", "neutral", "NEGATIVE", "other", None], "string")
    assert values(df, L.sentiment_number(F.col("label"))) == [1, 0, -1, None, None]


def test_dominant_sentiment_prefers_the_earlier_on_ties(spark):
    rows = [(50.0, 50.0, 0.0), (0.0, 50.0, 50.0), (50.0, 0.0, 50.0), (1.0, 1.0, 2.0), (0.0, 3.0, 2.0)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, p double, n double, g double")
    assert values(df, L.dominant_sentiment(F.col("p"), F.col("n"), F.col("g"))) == [
        "positive", "neutral", "positive", "negative", "neutral",
    ]


def test_priority_flag_bounds(spark):
    df = table(spark, "net", [-25.1, -25.0, -0.1, 0.0, 80.0], "double")
    assert values(df, L.priority_flag(F.col("net"))) == ["red", "amber", "amber", "green", "green"]


def test_round2_is_half_even_on_the_scaled_value(spark):
    import numpy as np

    xs = [66.665, 0.125, 0.375, 2.675, -0.125, 100 / 3, 33.335]
    df = table(spark, "x", xs, "double")
    assert values(df, L.round2(F.col("x"))) == [float(np.round(x, 2)) for x in xs]


def test_formatted_equals_python(spark):
    xs = [12.25, 12.35, 44.5, 45.5, 1234.5, 0.05, 99.95]
    df = table(spark, "x", xs, "double")
    assert values(df, L.formatted(F.col("x"), 1, "%")) == [f"{x:.1f}%" for x in xs]
    assert values(df, L.formatted(F.col("x"), 0)) == [f"{x:.0f}" for x in xs]
