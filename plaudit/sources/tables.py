"""Generic document, vector, page and dialogue tables seen as reviews."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F


# Declared, so that opening a table needs no job that reads footers.
SCHEMAS = {
    "documents": "doc_id long, text string, lang string, source string, n_chars long",
    "embeddings": "vec_id long, embedding array<float>, label int",
    "pages": "page_id long, url string, html string",
    "conversations": "conv_id long, turn long, role string, text string",
}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[name]).parquet(f"{folder}/{name}.parquet")


def document_reviews(spark: SparkSession, folder: str) -> DataFrame:
    """``documents`` as reviews: language is the sector, source the company."""
    return table(spark, folder, "documents").select(
        F.col("doc_id").alias("review_id"),
        F.col("lang").alias("category"),
        F.col("source").alias("company"),
        F.concat(F.lit("Company "), F.col("source")).alias("description"),
        F.split_part("text", F.lit("\n"), F.lit(1)).alias("title"),
        F.col("text").alias("review"),
        (1 + (F.col("doc_id") * 7 + F.col("n_chars")) % 5).cast("int").alias("stars"),
    )


def document_vectors(spark: SparkSession, folder: str) -> DataFrame:
    """``embeddings`` keyed by the review they belong to."""
    return table(spark, folder, "embeddings").select(
        F.col("vec_id").alias("review_id"), "embedding"
    )


def vector_seeds(spark: SparkSession, folder: str) -> DataFrame:
    """``embeddings`` as topic seeds: every vector of a label is a seed of its topic."""
    return table(spark, folder, "embeddings").select(
        F.col("label").alias("topic_id"),
        F.concat(F.lit("topic_"), F.col("label")).alias("macro_topic"),
        "embedding",
    )
