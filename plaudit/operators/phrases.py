"""Key phrases of topics: frequent word runs mined level by level, ranked by log-likelihood ratio."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from plaudit.constants import STOP_WORDS
from plaudit.functions import text as X
from plaudit.llm import arrays as A, bloom
from plaudit.plans.session import durable, durable_files, remove_durable, ship_package

MAX_WORDS = 4
MIN_COUNT = 10
# Candidates of a topic that are looked at for phrases unlike each other.
CANDIDATES = 200
# Stands for a token that is no word; a word has no digits.
_BREAK = "0"
# Filters of frequent runs are 8 MB a level; bytes of text worked on at once, and hashes held before they are counted.
_FILTER_BITS = 26
_BLOCK = 1 << 20
_HASHES = 2_000_000


def frequent_runs(
    reviews: DataFrame, max_words: int = MAX_WORDS, min_count: int = MIN_COUNT, topic: str = "macro_topic", text: str = "review"
) -> DataFrame:
    """``topic, run, n_words, n``: runs of 1 to ``max_words`` words that come ``min_count`` times in all, by topic.

    A word is a token without the marks at its ends, in lower case, of letters alone; whatever else
    stands between two words ends a run, also a token that is left empty. A run can only be frequent if the run without its last word and
    the run without its first word are, so each level counts only places where two frequent runs of
    the level before overlap. Places stay in their text: the levels count hashes of runs, and what is
    frequent among them is told to the texts by a filter of fixed size. What it lets pass by chance, or for a
    hash that two runs share, is dropped by the last count, which is of the runs themselves.
    Null texts have no words; a null topic is one.
    """
    if max_words < 1 or min_count < 1:
        raise ValueError("max_words and min_count must be 1 or more")
    spark = reviews.sparkSession
    ship_package(spark)
    bare = F.transform(X.words(F.lower(F.col(text))), X.bare_token)
    line = F.array_join(F.transform(bare, lambda w: F.when(w.rlike(r"^\p{L}+$"), w).otherwise(F.lit(_BREAK))), " ")
    lines = durable(reviews.select(F.col(topic).alias("topic"), line.alias("line")), "lines")  # a filter on it would make it twice
    filters: list[np.ndarray] = []
    for size in range(1, max_words + 1):
        often = durable(_run_hashes(lines, size, filters).groupBy("hash").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count), "run-hashes")
        filters.append(bloom.build(often, "hash", _FILTER_BITS))
        _drop(often)
        if not filters[-1].any():
            break
    counts = durable(_spelled_runs(lines, filters).groupBy("topic", "run", "n_words").agg(F.sum("n").alias("n")), "run-counts")
    _drop(lines)
    # A run has a row per topic at most.
    everywhere = F.sum("n").over(Window.partitionBy("run"))
    out = counts.withColumn("_all", everywhere).where(F.col("_all") >= min_count).drop("_all")
    return out.withColumnRenamed("topic", topic)


def _run_places(words: A.Words, size: int) -> np.ndarray:
    """By first word: whether ``size`` words follow each other there, in one text and without a break."""
    broken = (words.ends - words.starts == 1) & (words.data[words.starts] == ord(_BREAK))
    before = np.concatenate(([0], np.cumsum(broken)))
    texts = words.texts
    return (before[size:] == before[:-size]) & (texts[size - 1 :] == texts[: len(texts) - size + 1])


def _held_in(held: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    found = np.zeros(len(hashes), bool)
    found[bloom.passing(held, hashes, _FILTER_BITS)] = True
    return found


def _run_hashes(lines: DataFrame, size: int, filters: list[np.ndarray]) -> DataFrame:
    """``hash, n`` of the runs of ``size`` words, where both runs of one word less are in their filter."""
    before = lines.sparkSession.sparkContext.broadcast(filters[-1]) if filters else None

    def counted(hashes: list[np.ndarray]) -> pa.RecordBatch:
        found, n = np.unique(np.concatenate(hashes), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(A.signed(found)), pa.array(n)], ["hash", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, held = [], 0
        for batch in A.blocks(batches, "line", _BLOCK):
            words = A.words_of(batch.column("line"))
            if len(words.starts) < size:
                continue
            own = A.word_hashes(words)
            places = _run_places(words, size)
            if before is not None:
                shorter = _held_in(before.value, A.run_hashes(own, size - 1))
                places &= shorter[:-1] & shorter[1:]
            hashes.append(A.run_hashes(own, size)[places])
            held += len(hashes[-1])
            if held >= _HASHES:
                yield counted(hashes)
                hashes, held = [], 0
        if hashes:
            yield counted(hashes)

    return lines.select("line").mapInArrow(run, "hash long, n long")


def _spelled_runs(lines: DataFrame, filters: list[np.ndarray]) -> DataFrame:
    """``topic, run, n_words, n`` of the runs that are in the filter of their size, counted by batch."""
    held = lines.sparkSession.sparkContext.broadcast(filters)
    kind = lines.schema["topic"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in A.blocks(batches, "line", _BLOCK):
            words = A.words_of(batch.column("line"))
            own, texts = A.word_hashes(words), words.texts
            topics = batch.column("topic").dictionary_encode(null_encoding="encode").indices.to_numpy().astype(np.uint64)
            for size, filtered in enumerate(held.value, 1):
                if len(own) < size:
                    break
                hashes = A.run_hashes(own, size)
                at = np.flatnonzero(_run_places(words, size) & _held_in(filtered, hashes))
                _, first, n = np.unique(A.mix(hashes[at] + topics[texts[at]] * A._ODD), return_index=True, return_counts=True)
                at = at[first]
                starts, ends = words.starts[at], words.ends[at + size - 1]
                bounds = np.concatenate(([0], np.cumsum(ends - starts)))
                data = words.data[np.repeat(starts - bounds[:-1], ends - starts) + np.arange(bounds[-1])]
                data[data == 0] = ord(" ")
                spelled = pa.StringArray.from_buffers(len(at), pa.py_buffer(bounds.astype(np.int32)), pa.py_buffer(data))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("topic").take(pa.array(texts[at])), spelled, pa.array(np.full(len(at), size, np.int32)), pa.array(n)],
                    ["topic", "run", "n_words", "n"],
                )

    return lines.mapInArrow(run, f"topic {kind}, run string, n_words int, n long")


def _drop(table: DataFrame) -> None:
    for path in durable_files(table):
        remove_durable(table.sparkSession, path)


def _part(n: Column, expected: Column) -> Column:
    return F.when(n > 0, n * F.log(n / expected)).otherwise(F.lit(0.0))


def phrase_scores(runs: DataFrame, stop_words: Sequence[str] = STOP_WORDS, topic: str = "macro_topic") -> DataFrame:
    """``topic, run, n_words, n, n_all, g2`` of the runs that a topic has more often than the others.

    ``g2`` is the log-likelihood ratio of the run's counts in the topic and outside, against runs of as
    many words. Runs that begin or end with a stop word or a word of one letter are left out here, after they were counted.
    """
    # A run has a row per topic at most, and there are ``max_words`` sizes per topic: both windows are small.
    everywhere = Window.partitionBy("run")
    sizes = runs.groupBy(F.col(topic).alias("_topic"), F.col("n_words").alias("_words")).agg(F.sum("n").alias("size"))
    sizes = sizes.withColumn("all", F.sum("size").over(Window.partitionBy("_words")))
    rows = runs.withColumn("n_all", F.sum("n").over(everywhere)).join(
        sizes, F.col(topic).eqNullSafe(F.col("_topic")) & (F.col("n_words") == F.col("_words"))
    )
    inside, outside = F.col("n"), F.col("n_all") - F.col("n")
    share = F.col("n_all") / F.col("all")
    g2 = 2 * (_part(inside, share * F.col("size")) + _part(outside, share * (F.col("all") - F.col("size"))))
    ends = F.array(F.element_at(F.split("run", " "), 1), F.element_at(F.split("run", " "), -1))
    plain = F.forall(ends, lambda w: ~w.isin(*stop_words) & (F.length(w) > 1))
    return (
        rows.where(plain & (inside * (F.col("all") - F.col("size")) > outside * F.col("size")))
        .select(topic, "run", "n_words", "n", "n_all", g2.alias("g2"))
    )


def ranked_phrases(scores: DataFrame, top_n: int = CANDIDATES, min_words: int = 2, topic: str = "macro_topic") -> DataFrame:
    """The highest scores of each topic with their rank; equal scores by the run itself."""
    rank = F.row_number().over(Window.partitionBy(topic).orderBy(F.desc("g2"), "run")).cast("long")
    return scores.where(F.col("n_words") >= min_words).withColumn("rank", rank).where(F.col("rank") <= top_n)


def unlike_phrases(ranked: DataFrame, top_n: int = 10, most_shared: float = 0.5, topic: str = "macro_topic") -> DataFrame:
    """``topic, place, run, n, g2``: from the best on, each phrase that shares no more than ``most_shared`` of the words
    (of both together) with any phrase chosen before. A topic has as many rows here as were ranked."""
    ship_package(ranked.sparkSession)
    kinds = {f.name: f.dataType.simpleString() for f in ranked.schema}

    def choose(rows: pd.DataFrame) -> pd.DataFrame:
        chosen, words = [], []
        for at, run in enumerate(rows.sort_values("rank")["run"]):
            own = set(run.split(" "))
            if all(len(own & other) <= most_shared * len(own | other) for other in words):
                chosen.append(at)
                words.append(own)
                if len(chosen) == top_n:
                    break
        out = rows.sort_values("rank").iloc[chosen]
        return out.assign(place=range(1, len(out) + 1))[[topic, "place", "run", "n", "g2"]]

    return ranked.groupBy(topic).applyInPandas(choose, f"`{topic}` {kinds[topic]}, place long, run string, n long, g2 double")
