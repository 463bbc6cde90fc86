"""Exact dedup by skew-safe combining, with Spark's own operations only.

Rows are combined three times: inside each input partition (map-side aggregation), by digest and
salt, and by digest over the salts. Each time the full normalised text is part of the key, so texts
that share a digest never merge. A group with a third of all rows reaches the last step as one row
per salt. Members then look up their group by digest and salt; where several texts share a digest,
by full text as well.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

from plaudit.plans.session import durable

SALTS = 16
_SPACES = " \t\n\u000b\f\r"
# An id takes 19 digits; with the code points before it, both fit a decimal of 38.
_STEP = "10000000000000000000"


def squeezed(text: Column) -> Column:
    """The text without white space; null counts as empty."""
    text = F.coalesce(text, F.lit(""))
    for space in _SPACES:
        text = F.replace(text, F.lit(space), F.lit(""))
    return text


def sha(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def exact_dedup(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    salts: int = SALTS,
    digest: Callable[[Column], Column] = sha,
) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256, row_chars.

    Of equal texts the row with the most code points stays, then the one with the smallest id; a
    null id comes after all others. Rows that repeat both id and length of the row that stays are
    marked as it is. An empty table gives an empty result; other columns are not looked at.
    ``digest`` may be any function of the normalised text, ``salts`` any number.
    """
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.length(F.coalesce(F.col(text_col), F.lit(""))).alias("row_chars"),
        squeezed(F.col(text_col)).alias("norm"),
    ).select(
        "*",
        digest(F.col("norm")).alias("digest"),
        F.pmod(F.xxhash64("doc_id", "row_chars"), F.lit(salts)).alias("salt"),
    )
    # Of equal texts, the largest rank stays: more code points first, then the smaller id.
    id_rank = F.coalesce(F.col("doc_id"), F.lit((1 << 63) - 1)).cast("decimal(19,0)")
    rank = (F.col("row_chars").cast("decimal(10,0)") * F.lit(_STEP).cast("decimal(20,0)") - id_rank).cast(
        "decimal(38,0)"
    )
    best = [
        F.max("rank").alias("rank"),
        F.max_by("best_id", "rank").alias("best_id"),
        F.max_by("best_chars", "rank").alias("best_chars"),
    ]
    salted = (
        rows.withColumns({"rank": rank, "best_id": F.col("doc_id"), "best_chars": F.col("row_chars")})
        .groupBy("digest", "salt", "norm")
        .agg(F.count(F.lit(1)).alias("size"), *best)
    )
    winners = (
        salted.repartition("digest")
        .groupBy("digest", "norm")
        .agg(F.sum("size").alias("size"), F.collect_set("salt").alias("salts"), *best)
    )
    texts = F.count(F.lit(1)).over(Window.partitionBy("digest"))
    groups = durable(
        winners.withColumn("texts", texts).select(
            "digest", "size", "salts", "best_id", "best_chars",
            F.when(F.col("texts") > 1, F.col("norm")).alias("shared_norm"),
        ),
        "exact-dedup",
    )
    found = groups.withColumn("salt", F.explode("salts")).drop("salts")
    rows = rows.withColumn("text_sha256", sha(F.col("norm")))
    joined = rows.drop("norm").join(found.where("shared_norm IS NULL"), ["digest", "salt"])
    if not groups.where("shared_norm IS NOT NULL").isEmpty():  # collisions, settled by full text
        shared = rows.join(found.where("shared_norm IS NOT NULL"), ["digest", "salt"])
        joined = joined.unionByName(shared.where("norm = shared_norm").drop("norm"))
    return joined.select(
        "doc_id",
        F.col("best_id").alias("keep_id"),
        F.col("size").alias("group_size"),
        (F.col("doc_id").eqNullSafe(F.col("best_id")) & (F.col("row_chars") == F.col("best_chars"))).alias("kept"),
        "text_sha256",
        "row_chars",
    )
