"""Benchmark decontamination: a prefix-filtered set join with exact checks.

An item counts as the windows of its words: every run of ten, or all of a shorter item. A window is
a set of shingles (runs of three words; a shorter window is one shingle). A text can only hold a
window if it holds all its shingles, so the necessary prefix of a window, in order of rarity, is its
rarest shingle alone. Steps:

1. Count the items' shingles over all documents.
2. Keep for each distinct window its rarest shingle and that shingle's place in the window.
3. Join documents with windows on that shingle alone. The places give the positional bound (the
   window must start inside the text) and the length bound (it must end inside it).
4. Compare all words of the window with the text there.

Document shingles meet a Bloom filter of fixed size before any shuffle; what it lets through by
chance finds no partner in the join. The filter is the only thing sent to all tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from plaudit.llm import arrays as A, bloom
from plaudit.llm.rows import row_key
from plaudit.plans.session import durable

WINDOW = 10
SHINGLE = 3
# Frequent shingles are dealt over this many salts in the join.
SALTS = 8


def _words(words: A.Words, start: int, stop: int) -> list[str]:
    return [words.word(i).decode("utf-8", "replace") for i in range(start, stop)]


def item_windows(items: DataFrame, window: int, shingle: int, id_col: str, text_col: str) -> DataFrame:
    """item_id, words, and the shingles of each window with their places. Null or wordless: none."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in A.blocks(batches):
            words = A.words_of(batch.column("text"), A.ALNUM)
            hashes = A.word_hashes(words)
            ids = batch.column("item_id").to_pylist()
            out: dict[str, list] = {"item_id": [], "words": [], "shingles": []}
            for i, item in enumerate(ids):
                first, last = words.bounds[i], words.bounds[i + 1]
                if first == last:
                    continue
                size = min(window, last - first)
                step = min(shingle, size)
                runs = A.signed(A.run_hashes(hashes[first:last], step)).tolist()
                texts = _words(words, first, last)
                for at in range(last - first - size + 1):
                    out["item_id"].append(item)
                    out["words"].append(texts[at : at + size])
                    out["shingles"].append(runs[at : at + size - step + 1])
            yield pa.RecordBatch.from_pydict(
                out,
                pa.schema([("item_id", pa.int64()), ("words", pa.list_(pa.string())), ("shingles", pa.list_(pa.int64()))]),
            )

    return items.select(F.col(id_col).cast("long").alias("item_id"), F.col(text_col).alias("text")).mapInArrow(
        cut, "item_id long, words array<string>, shingles array<long>"
    )


def _scan(docs: DataFrame, filter_words, sizes: list[int], window: int, bits: int, context: bool) -> DataFrame:
    """Per document: its number of words, and the shingles of it that the filter lets through."""
    kind = "struct<shingle:long,place:int,before:int,words:array<string>>"
    schema = f"doc_id long, row_key long, n_words long, found array<{kind}>"
    kept = pa.struct(
        [("shingle", pa.int64()), ("place", pa.int32()), ("before", pa.int32()), ("words", pa.list_(pa.string()))]
    )

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in A.blocks(batches):
            words = A.words_of(batch.column("text"), A.ALNUM)
            hashes = A.word_hashes(words)
            texts = words.texts
            found: list[list[dict]] = [[] for _ in range(batch.num_rows)]
            for size in sizes:
                runs = A.run_hashes(hashes, size)
                for at in bloom.passing(filter_words.value, runs, bits).tolist():
                    doc = int(texts[at])
                    if texts[at + size - 1] != doc:
                        continue
                    first, last = int(words.bounds[doc]), int(words.bounds[doc + 1])
                    start, stop = max(first, at - window + 1), min(last, at + window)
                    found[doc].append(
                        {
                            "shingle": int(A.signed(runs[at : at + 1])[0]),
                            "place": at - first,
                            "before": at - start,
                            "words": _words(words, start, stop) if context else None,
                        }
                    )
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"), batch.column("row_key"),
                    pa.array(words.counts, pa.int64()), pa.array(found, pa.list_(kept)),
                ],
                ["doc_id", "row_key", "n_words", "found"],
            )

    return docs.mapInArrow(scan, schema)


def contamination(
    docs: DataFrame,
    items: DataFrame,
    window: int = WINDOW,
    shingle: int = SHINGLE,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    filter_bits: int = bloom.BITS,
    salts: int = SALTS,
) -> DataFrame:
    """One row per document: doc_id, row_key, n_words, n_hit, n_items, items (ids as sorted strings).

    A word is a run of letters, digits and non-ASCII characters, A-Z lowered. A word inside any
    occurrence of a window is hit. Null or empty texts have no words and hold nothing; null or
    empty items have no windows; a null item id is named ''. Rows that repeat id and text give the
    same figures each. Empty tables and other columns do no harm.
    """
    spark = docs.sparkSession
    windows = durable(item_windows(items, window, shingle, item_id, item_text), "benchmark-windows")
    shingles = windows.select(
        F.posexplode("shingles").alias("place", "shingle"), F.size("words").alias("size"), "words"
    )
    sizes = sorted({min(shingle, n) for (n,) in windows.select(F.least(F.size("words"), F.lit(shingle))).distinct().collect()})
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"),
        row_key(F.col(id_col).cast("long"), F.col(text_col)).alias("row_key"),
    )
    every = spark.sparkContext.broadcast(bloom.build(shingles, "shingle", filter_bits))
    counts = (
        _scan(rows, every, sizes, window, filter_bits, context=False)
        .select(F.explode("found.shingle").alias("shingle"))
        .groupBy("shingle")
        .count()
    )
    rarest = Window.partitionBy("words").orderBy(F.coalesce("count", F.lit(0)), "shingle", "place")
    prefixes = durable(
        shingles.distinct()
        .join(counts, "shingle", "left")
        .withColumn("order", F.row_number().over(rarest))
        .where("order = 1")
        .select("shingle", "words", "size", "place"),
        "benchmark-prefixes",
    )
    chosen = spark.sparkContext.broadcast(bloom.build(prefixes, "shingle", filter_bits))
    scanned = durable(_scan(rows, chosen, sizes, window, filter_bits, context=True), "benchmark-candidates")
    candidates = (
        scanned.select("doc_id", "row_key", "n_words", F.explode("found").alias("f"))
        .select("doc_id", "row_key", "n_words", "f.*")
        .withColumn("salt", F.pmod(F.xxhash64("row_key", "place"), F.lit(salts)))
    )
    needed = prefixes.select(
        "shingle", "size", F.col("place").alias("offset"), F.col("words").alias("window_words"),
        F.explode(F.expr(f"sequence(0L, {salts - 1}L)")).alias("salt"),
    )
    start = F.col("place") - F.col("offset")
    held = F.slice("words", F.col("before") - F.col("offset") + 1, F.col("size"))
    hits = (
        candidates.join(needed, ["shingle", "salt"])
        .where((start >= 0) & (start + F.col("size") <= F.col("n_words")))
        .where((F.col("before") >= F.col("offset")) & (held == F.col("window_words")))
        .select("doc_id", "row_key", start.alias("start"), (start + F.col("size")).alias("stop"), "window_words")
    )
    hits = durable(hits, "benchmark-hits")
    # Words covered: each occurrence adds what reaches past all that begin before it.
    by_start = Window.partitionBy("doc_id", "row_key").orderBy("start", "stop")
    reached = F.coalesce(F.max("stop").over(by_start.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    covered = (
        hits.select("doc_id", "row_key", "start", "stop").distinct()
        .withColumn("new", F.greatest(F.col("stop") - F.greatest("start", reached), F.lit(0)))
        .groupBy("doc_id", "row_key")
        .agg(F.sum("new").alias("n_hit"))
    )
    owners = windows.select(
        F.col("words").alias("window_words"), F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item")
    ).distinct()
    named = (
        hits.select("doc_id", "row_key", "window_words").distinct()
        .join(owners, "window_words")
        .groupBy("doc_id", "row_key")
        .agg(F.array_sort(F.collect_set("item")).alias("items"))
    )
    return (
        scanned.select("doc_id", "row_key", "n_words").alias("d")
        .join(covered.alias("c"), _same("d", "c"), "left")
        .join(named.alias("n"), _same("d", "n"), "left")
        .select(
            "d.doc_id", "d.row_key", "d.n_words",
            F.coalesce("c.n_hit", F.lit(0)).cast("long").alias("n_hit"),
            F.coalesce(F.size("n.items"), F.lit(0)).cast("long").alias("n_items"),
            F.coalesce("n.items", F.array().cast("array<string>")).alias("items"),
        )
    )


def _same(a: str, b: str):
    return (F.col(f"{a}.row_key") == F.col(f"{b}.row_key")) & F.col(f"{a}.doc_id").eqNullSafe(F.col(f"{b}.doc_id"))
