"""Additive states against statistics of the reviews themselves."""

import pytest
from compare import rows_of
from pyspark.sql import functions as F

from plaudit.operators import cleaning, companies, compare, state as S

COLUMNS = "review_id long, category string, company string, title string, review string, stars int, review_word_count int, title_word_count int"


def reviews(spark, n=400):
    rows = [
        (i, ("a", "b", None)[i % 3 if i % 7 else 2], (f"c{i % 5}" if i % 11 else None), "t x"[: i % 4], None if i % 13 == 0 else "w " * (i % 9),
         None if i % 17 == 0 else 1 + i * 7 % 5, i % 9, i % 3)
        for i in range(n)
    ]
    return spark.createDataFrame(rows, COLUMNS).repartition(3)


def assembled(spark, n=300):
    rows = [(i, i % 3 == 0, f"t{i % 4}", ("positive", "neutral", "negative")[i * i % 3], None if i % 10 == 0 else (i * 37 % 100) / 101) for i in range(n)]
    return spark.createDataFrame(rows, "review_id long, is_target boolean, macro_topic string, sentiment string, topic_similarity double")


def same(a, b):
    def rounded(df):
        return df.select(*(F.round(c, 6).alias(c) if k == "double" else F.col(c) for c, k in df.dtypes))

    a, b = rounded(a), rounded(b)
    return rows_of(a.columns, a.collect()) == rows_of(b.columns, b.collect())


def test_statistics_of_a_state_are_those_of_the_reviews(spark):
    rows = reviews(spark)
    held = S.tally(rows, S.company_layout())
    assert same(S.company_stats(held), companies.company_stats(rows))
    named = rows.where("category is not null")
    want = companies.describe(named, ["stars"], ["category"]).drop("metric")
    assert same(S.describe_stars(held.where("category is not null")), want)
    assert same(S.length_limits(S.tally(rows, S.length_layout())), companies.length_limits(rows))
    topics = assembled(spark)
    assert same(S.topic_summary(S.tally(topics, S.topic_layout())), compare.topic_summary(topics))
    stars = companies.star_distribution(rows).select("category", "stars", "n")
    assert same(S.star_distribution(held), stars.where("category is not null and stars is not null"))


@pytest.mark.parametrize("layout, make", [(S.company_layout, reviews), (S.length_layout, reviews), (S.topic_layout, assembled)])
def test_add_and_take_back_leaves_what_was_there(spark, tmp_path, layout, make):
    rows, layout = make(spark), layout()
    store = S.StateStore(spark, str(tmp_path / "state"), layout)
    assert store.current() is None and store.applied() == []
    part = [rows.where(F.pmod("review_id", F.lit(4)) == k) for k in range(4)]
    for k in (0, 1, 2):
        assert store.apply(f"b{k}", add=part[k])
    before = store.current()
    kept = rows_of(before.columns, before.collect())
    assert store.apply("b3", add=part[3])
    full = S.tally(rows, layout)
    assert rows_of(full.columns, full.collect()) == rows_of(full.columns, store.current().select(*full.columns).collect())
    assert store.apply("b3 back", withdraw=part[3])
    now = store.current()
    assert rows_of(now.columns, now.collect()) == kept
    assert store.apply("swap", add=part[3], withdraw=part[0])
    want = S.tally(part[1].unionByName(part[2]).unionByName(part[3]), layout)
    now = store.current().select(*want.columns)
    assert rows_of(now.columns, now.collect()) == rows_of(want.columns, want.collect())
    assert len(store.versions()) == 2


def test_a_batch_counts_once(spark, tmp_path):
    store = S.StateStore(spark, str(tmp_path / "state"), S.length_layout())
    rows = reviews(spark, 50)
    assert store.apply("x", add=rows) and not store.apply("x", add=rows)
    assert store.current().agg(F.sum("n")).first()[0] == 50 and store.applied() == ["x"]


def test_too_much_taken_back_is_refused(spark, tmp_path):
    store = S.StateStore(spark, str(tmp_path / "state"), S.company_layout())
    rows = reviews(spark, 60)
    store.apply("x", add=rows.where("review_id < 30"))
    with pytest.raises(ValueError):
        store.apply("y", withdraw=rows.where("review_id >= 20"))
    with pytest.raises(ValueError):
        S.StateStore(spark, str(tmp_path / "other"), S.company_layout()).apply("z")
    assert store.applied() == ["x"] and store.current().agg(F.sum("n")).first()[0] == 30
    assert store.apply("y", withdraw=rows.where("review_id < 30")) and store.current().count() == 0
    assert S.company_stats(store.current()).count() == 0


def test_an_interrupted_version_is_none(spark, tmp_path):
    store = S.StateStore(spark, str(tmp_path / "state"), S.length_layout())
    rows = reviews(spark, 40)
    store.apply("x", add=rows)
    S.tally(rows, S.length_layout()).write.parquet(store._path(1, "state"))  # no ledger: the writer was lost
    assert store.versions() == [0]
    assert store.apply("y", add=rows) and store.current().agg(F.sum("n")).first()[0] == 80


def test_a_stream_feeds_a_state(spark, tmp_path):
    rows = reviews(spark, 90).drop("review_word_count", "title_word_count")
    rows.repartition(3).write.parquet(str(tmp_path / "in"))
    store = S.StateStore(spark, str(tmp_path / "state"), S.company_layout())

    def take(batch, epoch):
        store.apply(f"epoch {epoch}", add=cleaning.add_length_features(batch))

    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = stream.writeStream.foreachBatch(take).option("checkpointLocation", str(tmp_path / "at")).trigger(availableNow=True).start()
    query.awaitTermination()
    assert len(store.applied()) >= 3
    assert same(S.company_stats(store.current()), companies.company_stats(rows))
