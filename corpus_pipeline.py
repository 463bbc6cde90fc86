"""From raw documents to packed training sequences, in five stages.

Each stage is a function of (spark, docs, sf_dir) and returns the documents it keeps, with their
columns; the last returns packed pieces. ``run`` writes every stage's result as Parquet and reads it
again, so a lost executor costs no more than one stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from plaudit.llm import decontaminate, exact_dedup, jaccard_join, packing, quality
from plaudit.llm.queries import TOKENIZER
from plaudit.llm.rows import row_key, table
from plaudit.plans.session import durable, ship_package


def _keep(docs: DataFrame, kept: DataFrame, **parts) -> DataFrame:
    """The documents that match a row of ``kept``: its columns against expressions, nulls included."""
    kept = kept.select(*(F.col(name).alias(f"__kept_{name}") for name in parts)).distinct()
    tagged = docs.withColumns({f"__{name}": part for name, part in parts.items()})
    same = [F.col(f"__{name}").eqNullSafe(F.col(f"__kept_{name}")) for name in parts]
    return tagged.join(kept, same, "left_semi").select(*docs.columns)


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops what the classifier scores under its threshold. Labels come from the tables."""
    ship_package(spark)
    weights = quality.train(docs, table(spark, sf_dir, "labels"))
    scored = quality.score_quality(docs, weights, output="__score")
    return scored.where(F.col("__score") >= quality.THRESHOLD).select(*docs.columns)


def exact_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts stays."""
    found = exact_dedup.exact_dedup(docs).where("kept")
    chars = F.length(F.coalesce(F.col("text"), F.lit("")))
    return _keep(docs, found, doc_id=F.col("doc_id"), row_chars=chars)


def jaccard_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of near copies the document with the smallest id stays."""
    ship_package(spark)
    found = jaccard_join.jaccard_groups(docs).where(F.col("doc_id").eqNullSafe(F.col("component_id")))
    return _keep(docs, found, doc_id=F.col("doc_id"))


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go."""
    found = decontaminate.contamination(docs, table(spark, sf_dir, "benchmark")).where("n_hit = 0")
    return _keep(docs, found, doc_id=F.col("doc_id"), row_key=row_key(F.col("doc_id"), F.col("text")))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of all documents left, in windows without padding."""
    ship_package(spark)
    return packing.pack(docs, public_tokenizers.path(TOKENIZER))


STAGES = [
    ("quality classifier", quality_stage),
    ("exact dedup", exact_dedup_stage),
    ("n-gram Jaccard join", jaccard_stage),
    ("benchmark decontamination", decontamination_stage),
    ("packing", packing_stage),
]

# The classifier is not expressible in SQL; tests compare each stage with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = durable(stage(spark, docs, sf_dir), f"stage-{name.replace(' ', '-')}")
    return STAGES[-1][1](spark, docs, sf_dir)
