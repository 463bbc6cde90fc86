import pytest

from plaudit.operators.cleaning import clean_reviews
from plaudit.plans import session
from plaudit.plans.comparison import RESULTS, assemble, compare_company
from plaudit.plans.sector import explore_sector
from plaudit.streaming.rowwise import prepare_reviews
from workloads.stubs import letter_encoder, vowel_classifier

SCHEMA = "review_id long, category string, company string, description string, title string, review string, stars int"


@pytest.fixture(scope="module")
def reviews(spark):
    rows = [
        (i, "Sports" if i % 4 else "Utilities", f"c{i % 3}", "about", f"title {i}",
         ("great delivery &amp; price" if i % 2 else "awful late parcel") + " e" * (i % 6), i % 5 + 1)
        for i in range(240)
    ]
    return spark.createDataFrame(rows + [(999, "Sports", "c0", "d", "t", " ", 1)], SCHEMA)


def test_compare_company(spark, reviews):
    result = compare_company(clean_reviews(reviews), "c0", letter_encoder, min_reviews=1, max_reviews=2)
    assert result.target.count() == 80 and result.competitors.count() == 160
    assert set(RESULTS) <= set(result.target.columns)
    assert sum(r.n_reviews for r in result.summary_target.collect()) == 80
    assert result.centroids.count() == 8
    for r in result.merged.collect():
        assert r.gap == pytest.approx(r.net_sentiment_target - r.net_sentiment_comp)
        assert -100 <= r.net_sentiment_target <= 100
    for table in result.root_cause:
        table.count()
    # The assembled reviews are read from the durable table; no model runs again.
    plan = result.merged._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython" not in plan and "FileScan parquet" in plan


def test_kept_and_lazy_results_agree(reviews):
    cleaned = clean_reviews(reviews)
    kept, lazy = (
        compare_company(cleaned, "c1", letter_encoder, classifier_factory=vowel_classifier, keep=k)
        for k in (True, False)
    )
    assert kept.summary_target.collect() == lazy.summary_target.collect()
    assert kept.merged.collect() == lazy.merged.collect()


def test_own_vectors_and_centroids(spark, reviews):
    from plaudit.operators.models import embed_texts, topic_seeds
    from plaudit.operators.topics import seed_centroids

    cleaned = clean_reviews(reviews)
    with_vectors = embed_texts(cleaned, "review", letter_encoder)
    centroids = seed_centroids(embed_texts(topic_seeds(spark), "seed", letter_encoder))
    rows = assemble(with_vectors, "c2", centroids)
    assert "embedding" not in rows.columns and rows.count() == 240
    with pytest.raises(ValueError, match="encoder"):
        compare_company(cleaned, "c2")
    with pytest.raises(ValueError, match="not found"):
        compare_company(cleaned, "nobody", letter_encoder)


def test_explore_sector(reviews):
    report = explore_sector(reviews, "Sports", "c1")
    assert report.features.count() == 181
    assert {r.company for r in report.stats.collect()} == {"c0", "c1", "c2"}
    for name, table in report._asdict().items():
        assert table.count() > 0, name
    lazy = explore_sector(reviews, "Sports", "c1", keep=False)
    assert lazy.percentile_dashboard.collect() == report.percentile_dashboard.collect()


def test_durable_tables_lie_in_the_shared_folder_and_can_be_removed(spark):
    table = session.durable(spark.range(5), "five")
    (path,) = session.durable_files(table)
    shared = spark.conf.get("spark.checkpoint.dir")
    assert path.startswith(f"file://{shared}/five-") or path.startswith(f"file:{shared}/five-")
    assert table.count() == 5
    assert session.remove_durable(spark, path) and not session.remove_durable(spark, path)


def test_blank_reviews_are_not_embedded(spark, reviews, tmp_path):
    seen = str(tmp_path / "seen")

    def factory():
        encode = letter_encoder()

        def counting(texts):
            with open(seen, "a") as out:
                out.writelines("blank\n" for t in texts if not t.strip())
            return encode(texts)

        return counting

    open(seen, "w").close()
    compare_company(clean_reviews(reviews), "c0", factory, min_reviews=1)
    assert open(seen).read() == ""


def test_a_classifier_sees_each_row_once(spark, reviews, tmp_path):
    seen = str(tmp_path / "seen")

    def factory():
        classify = vowel_classifier()

        def counting(texts):
            with open(seen, "a") as out:
                out.writelines("x\n" for _ in texts)
            return classify(texts)

        return counting

    open(seen, "w").close()
    result = compare_company(
        clean_reviews(reviews), "c0", letter_encoder, classifier_factory=factory, min_reviews=1
    )
    for table in result.root_cause:
        table.count()
    assert len(open(seen).readlines()) == 240


def test_models_load_once_per_worker(spark, tmp_path):
    from plaudit.operators.models import embed_texts, score_sentiment

    seen = str(tmp_path / "loads")

    def noted(make, name):
        def factory():
            import os

            with open(seen, "a") as out:
                out.write(f"{name} {os.getpid()}\n")
            return make()

        return factory

    open(seen, "w").close()
    rows = spark.range(64).selectExpr("id", "'some text' AS t").repartition(32)
    both = score_sentiment(
        embed_texts(rows, "t", noted(letter_encoder, "e")), "t", noted(vowel_classifier, "c")
    )
    for _ in range(2):
        both.write.format("noop").mode("overwrite").save()
    loads = open(seen).read().splitlines()
    assert loads and len(loads) == len(set(loads))


def test_row_wise_operators_run_on_a_stream(spark, reviews, tmp_path):
    source = str(tmp_path / "in")
    reviews.repartition(3).write.parquet(source)
    stream = spark.readStream.schema(reviews.schema).parquet(source)
    query = (
        prepare_reviews(stream).writeStream.format("memory").queryName("prepared").outputMode("append")
        .option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    )
    query.awaitTermination(120)
    streamed = spark.table("prepared").orderBy("review_id").collect()
    assert streamed == prepare_reviews(reviews).orderBy("review_id").collect()
