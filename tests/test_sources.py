import pytest
from pyspark.sql import functions as F

from plaudit.operators.cleaning import clean_reviews, clean_sector
from plaudit.sources import reviews as S

TEXT = 'He said "no",\nthen left. \\n Ôla, bye'
ROWS = [
    ("Sports", "a.com", "desc", "title, with comma", TEXT, 5),
    ("Sports", "b.com", None, "", "x", None),
    ("Utilities", "c.com", "d", "t", "r", 1),
    (None, "d.com", "d", "t", "r", 1),
]


@pytest.fixture(scope="module")
def reviews(spark):
    return spark.createDataFrame(ROWS, S.REVIEW_SCHEMA)


def test_csv_round_trip(spark, reviews, tmp_path):
    path = str(tmp_path / "csv")
    S.write_reviews(reviews, path, "csv")
    back = S.read_reviews_csv(spark, path)
    assert back.schema == S.REVIEW_SCHEMA
    found = {r.company: r for r in back.collect()}
    assert found["a.com"].review == TEXT and found["a.com"].stars == 5
    assert found["b.com"].title is None and found["b.com"].stars is None  # '' is null in CSV


def test_parquet_keeps_blank_apart_from_null_and_prunes_sectors(spark, reviews, tmp_path):
    path = str(tmp_path / "parquet")
    S.write_reviews(reviews, path, partition_by="category")
    back = S.read_reviews(spark, path)
    (b,) = back.where("company = 'b.com'").collect()
    assert b.title == "" and b.description is None
    plan = clean_sector(back, "Sports")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(category" in plan


def test_company_list(spark, tmp_path):
    path = str(tmp_path / "companies")
    rows = spark.createDataFrame([("Sports", "a.com", 4.0, 3.5, 1.25)], S.COMPANY_SCHEMA)
    rows.write.csv(path, header=True)
    assert S.read_companies(spark, path).collect() == rows.collect()
    rows.write.parquet(path + ".parquet")
    assert S.read_companies(spark, path + ".parquet", "parquet").collect() == rows.collect()


def test_checks(reviews):
    with pytest.raises(ValueError, match="sports"):
        clean_sector(reviews, "sports")
    with pytest.raises(KeyError, match="stars"):
        clean_sector(reviews.drop("stars"), "Sports")
    assert clean_sector(reviews, "Sports", sectors=["Sports"]).count() == 2
    assert clean_sector(reviews, "Hobbies & Crafts").count() == 0


def test_clean_sector_cleans_the_columns_that_exist(reviews):
    found = {r.company: r for r in clean_sector(reviews.drop("description"), "Sports").collect()}
    a, b = found["a.com"], found["b.com"]
    assert a.review == "He said no , then left. Ola, bye" and not a.is_empty_review
    assert (b.title, b.is_empty_review) == ("", False)
    assert clean_reviews(reviews, ["title"]).where("company = 'a.com'").first().review == TEXT


def test_empty_review_flag(spark):
    rows = spark.createDataFrame([("€€",), (None,), ("ok",)], "review string")
    assert [r.is_empty_review for r in clean_reviews(rows).collect()] == [True, True, False]


def test_only_needed_columns_are_read(spark, reviews, tmp_path):
    path = str(tmp_path / "wide")
    S.write_reviews(reviews, path)
    from plaudit.operators.companies import star_distribution

    plan = star_distribution(S.read_reviews(spark, path))._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<category:string,stars:int>" in plan
