"""Review and company tables: schemas, readers, writers and structural checks."""

from __future__ import annotations

from collections.abc import Collection

from pyspark.sql import DataFrame, SparkSession, types as T

from plaudit.constants import REQUIRED_COLUMNS, SECTORS

REVIEW_SCHEMA = T.StructType(
    [
        T.StructField("category", T.StringType()),
        T.StructField("company", T.StringType()),
        T.StructField("description", T.StringType()),
        T.StructField("title", T.StringType()),
        T.StructField("review", T.StringType()),
        T.StructField("stars", T.IntegerType()),
    ]
)
COMPANY_SCHEMA = T.StructType(
    [
        T.StructField("category", T.StringType()),
        T.StructField("company", T.StringType()),
        T.StructField("median_stars", T.DoubleType()),
        T.StructField("media_stars", T.DoubleType()),
        T.StructField("std_stars", T.DoubleType()),
    ]
)
_CSV = {"header": True, "quote": '"', "escape": '"'}


def read_reviews_csv(
    spark: SparkSession, path: str, schema: T.StructType = REVIEW_SCHEMA, multi_line: bool = True
) -> DataFrame:
    """Reviews from CSV with a header and a declared schema (no inference pass).

    A file with quoted line breaks is read by one task here; :func:`plaudit.sources.split_csv.read_csv_by_ranges`
    reads it by many. Convert large inputs to Parquet once with :func:`write_reviews`.
    """
    return spark.read.schema(schema).csv(path, multiLine=multi_line, **_CSV)


def read_reviews(spark: SparkSession, path: str) -> DataFrame:
    """Reviews from Parquet; with ``category`` folders a sector filter prunes the rest."""
    return spark.read.parquet(path)


def read_companies(spark: SparkSession, path: str, fmt: str = "csv") -> DataFrame:
    """The company list, from CSV or Parquet."""
    if fmt == "csv":
        return spark.read.schema(COMPANY_SCHEMA).csv(path, **_CSV)
    return spark.read.format(fmt).load(path)


def write_reviews(
    reviews: DataFrame, path: str, fmt: str = "parquet", mode: str = "errorifexists",
    partition_by: str | None = None,
) -> None:
    """Write reviews. Parquet keeps ``''`` apart from null, CSV does not."""
    writer = reviews.write.mode(mode)
    if partition_by:
        writer = writer.partitionBy(partition_by)
    if fmt == "csv":
        writer.csv(path, **_CSV)
    else:
        writer.format(fmt).save(path)


def require_columns(reviews: DataFrame, columns: Collection[str] = REQUIRED_COLUMNS) -> None:
    """KeyError when a column is missing; reads the schema only."""
    missing = sorted(set(columns) - set(reviews.columns))
    if missing:
        raise KeyError(f"missing required columns: {missing}")


def require_sector(category: str, sectors: Collection[str] = SECTORS) -> None:
    """ValueError when the sector is unknown; exact and case-sensitive."""
    if category not in sectors:
        raise ValueError(f"unknown category {category!r}; valid are: {', '.join(sectors)}")
