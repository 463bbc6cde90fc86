"""Small helpers of the document operators: inputs, row keys, held-out folds, run folders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from plaudit.plans.session import ship_package

SCHEMAS = {
    "documents": "doc_id long, text string, lang string, source string, n_chars long",
    "pages": "page_id long, url string, html string",
    "benchmark": "item_id long, text string",
    "embeddings": "vec_id long, embedding array<float>, label int",
    "labels": "doc_id long, quality int, toxic int",
}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One of the corpus tables, with a declared schema."""
    ship_package(spark)
    return spark.read.schema(SCHEMAS[name]).parquet(f"{folder}/{name}.parquet")


def row_key(doc_id: Column, text: Column) -> Column:
    """A 64-bit digest of id and text: tells repeated ids apart; rows alike in both share it."""
    return F.xxhash64(doc_id, text)


def fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; null ids count as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds
