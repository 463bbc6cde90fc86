"""CSV by byte ranges against the reader that takes a file in one task."""

import random

import pytest
from pyspark.sql import functions as F

from plaudit.sources.reviews import read_reviews_csv, write_reviews
from plaudit.sources.split_csv import csv_records, read_csv_by_ranges

TEXTS = ["plain", 'he said "no"', "two\nlines", 'a "b\nc" d, e', "\n\n\n", '"', '""', ",", "é 👍", "x" * 300, '"\n"', "tail\n", ' spaced ', 'many\n' * 40]


@pytest.fixture
def small_ranges(spark):
    keys = {"spark.sql.files.maxPartitionBytes": "700", "spark.sql.files.openCostInBytes": "1"}
    before = {key: spark.conf.get(key) for key in keys}
    for key, value in keys.items():
        spark.conf.set(key, value)
    yield
    for key, value in before.items():
        spark.conf.set(key, value)


def rows_of(df):
    return sorted(map(repr, df.collect()))


def reviews(spark, n, rng):
    rows = [(f"s{i % 3}", f"c{i}", rng.choice(TEXTS), None if i % 11 == 0 else rng.choice(TEXTS), rng.choice(TEXTS), None if i % 7 == 0 else i % 5 + 1) for i in range(n)]
    return spark.createDataFrame(rows, "category string, company string, description string, title string, review string, stars int")


@pytest.mark.parametrize("seed", range(3))
def test_equal_to_the_read_in_one_task(spark, tmp_path, small_ranges, seed):
    path = str(tmp_path / "in")
    write_reviews(reviews(spark, 150, random.Random(seed)).coalesce(2), path, "csv")
    found = read_csv_by_ranges(spark, path)
    assert rows_of(found) == rows_of(read_reviews_csv(spark, path))
    assert found.count() == 150
    records = csv_records(spark, path)
    assert records.select("file", "at").distinct().count() > 20  # many ranges of two files
    assert records.groupBy("file", "at", "place").count().where("count > 1").isEmpty()


def test_line_ends_and_blank_lines(spark, tmp_path, small_ranges):
    path = tmp_path / "in.csv"
    head = "category,company,description,title,review,stars"
    path.write_bytes(f'{head}\r\na,b,c,d,"e\r\nf",5\r\n\r\ng,h,,"","x ""y"" z",\r\nlast,h,i,j,k,1'.encode())
    assert rows_of(read_csv_by_ranges(spark, str(path))) == rows_of(read_reviews_csv(spark, str(path)))
    empty = tmp_path / "empty.csv"
    empty.write_text(f"{head}\n")
    assert read_csv_by_ranges(spark, str(empty)).count() == 0


def test_a_record_over_many_ranges(spark, tmp_path, small_ranges):
    long = "line of a long review\n" * 400
    rows = [("s", "a", "d", "t", "short", 1), ("s", "b", "d", "t", long, 2), ("s", "c", "d", long + '"quoted"\n', long, 3), ("s", "d", "d", "t", "end", 4)]
    table = spark.createDataFrame(rows, "category string, company string, description string, title string, review string, stars int")
    write_reviews(table.coalesce(1), str(tmp_path / "in"), "csv")
    found = read_csv_by_ranges(spark, str(tmp_path / "in"))
    assert rows_of(found) == rows_of(read_reviews_csv(spark, str(tmp_path / "in"))) and found.count() == 4
