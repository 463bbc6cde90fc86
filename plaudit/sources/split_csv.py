"""CSV with quoted line breaks, read by many tasks a file.

Where a line begins a record depends on all quotes before it: it does if their number is even. So every byte
range first counts its quotes; running sums over the ranges tell each one whether it begins inside
quotes, and then every task finds its records by itself. Only records that cross ranges are put together
by a shuffle, at most two pieces a range.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from plaudit.plans.session import ship_package
from plaudit.sources.reviews import REVIEW_SCHEMA

_RANGES = "file string, at long, odd boolean, begins_even boolean, begins_odd boolean"
_PIECES = "file string, owner long, at long, place long, whole boolean, text string"


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines with their file and the start of their byte range; a range's lines come in order."""
    lines = spark.read.option("lineSep", "\n").text(path)
    return lines.select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("at"))


def _by_range(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, pa.Array]]:
    """Runs of lines of one range; a range may come in several runs, in order."""
    for batch in batches:
        if not batch.num_rows:
            continue
        files, at = batch.column("file").dictionary_encode(), batch.column("at").to_numpy(zero_copy_only=False)
        of = files.indices.to_numpy(zero_copy_only=False)
        cuts = [0, *(np.flatnonzero((of[1:] != of[:-1]) | (at[1:] != at[:-1])) + 1).tolist(), batch.num_rows]
        for first, last in zip(cuts, cuts[1:]):
            yield files.dictionary[of[first]].as_py(), int(at[first]), batch.column("value").slice(first, last - first)


def _quotes(lines: pa.Array) -> np.ndarray:
    return pc.count_substring(lines, '"').to_numpy(zero_copy_only=False)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each range: whether its quotes are odd, and whether a record begins in it, from either state."""
    found: dict[tuple[str, int], list[bool]] = {}
    for file, at, lines in _by_range(batches):
        state = found.setdefault((file, at), [False, False, False])
        before = np.concatenate(([int(state[0])], int(state[0]) + np.cumsum(_quotes(lines)))) % 2
        state[1] |= bool((before[:-1] == 0).any())
        state[2] |= bool((before[:-1] == 1).any())
        state[0] = bool(before[-1])
    rows = [(*key, *state) for key, state in found.items()]
    columns = list(zip(*rows, strict=True)) or [[]] * 5
    kinds = [pa.string(), pa.int64(), pa.bool_(), pa.bool_(), pa.bool_()]
    names = [part.split()[0] for part in _RANGES.split(", ")]
    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)


def csv_records(spark: SparkSession, path: str) -> DataFrame:
    """``file, at, place, text``: every record of the files as it is written, quotes and breaks included.

    ``at`` is the range that a record begins in, ``place`` its number there, so both order the records of a file.
    Quotes must be doubled inside quoted fields and stand nowhere else, as in RFC 4180; a quote that
    is never closed makes one record of the rest of its file. Lines end with a line feed, or with a
    carriage return before it, which is kept.
    """
    ship_package(spark)
    lines = _lines(spark, path)
    ranges = lines.mapInArrow(_count, _RANGES).orderBy("file", "at").collect()  # one row a byte range
    inside: dict[tuple[str, int], tuple[bool, int]] = {}  # begins inside quotes; the range whose record that is
    file, odd, owner = None, False, 0
    for row in ranges:
        if row["file"] != file:
            file, odd, owner = row["file"], False, row["at"]
        inside[file, row["at"]] = (odd, owner)
        if row["begins_odd"] if odd else row["begins_even"]:
            owner = row["at"]
        odd ^= row["odd"]
    held = spark.sparkContext.broadcast(inside)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, odd, owner, place, open_lines = None, False, 0, 0, []

        def row(whole: bool) -> tuple:
            return (*key[:1], owner, key[1], place, whole, "\n".join(open_lines))

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.string()]
            columns = list(zip(*rows, strict=True)) or [[]] * 6
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], [p.split()[0] for p in _PIECES.split(", ")])

        for file, at, lines in _by_range(batches):
            rows = []
            if (file, at) != key:
                if open_lines:  # the last record of the range before, perhaps to be continued
                    rows.append(row(False))
                key, place, open_lines = (file, at), -1, []
                odd, owner = held.value[key]
            counts = _quotes(lines)
            for line, quotes in zip(lines.to_pylist(), counts.tolist(), strict=True):
                if not odd:
                    if open_lines:
                        # A piece that began in another range is put together there.
                        rows.append(row(place >= 0))
                    place, owner, open_lines = place + 1, at, []
                open_lines.append(line)
                odd ^= bool(quotes % 2)
            yield batch_of(rows)
        if open_lines:
            yield batch_of([row(False)])

    pieces = lines.mapInArrow(cut, _PIECES)
    whole = pieces.where("whole").select("file", F.col("owner").alias("at"), "place", "text")
    # The first piece of a record that goes on has its place; pieces from later ranges have -1.
    joined = pieces.where("not whole").groupBy("file", "owner").agg(
        F.max("place").alias("place"), F.array_sort(F.collect_list(F.struct("at", "place", "text"))).alias("pieces")
    )
    return whole.unionByName(
        joined.select("file", F.col("owner").alias("at"), "place", F.array_join(F.transform("pieces", lambda p: p["text"]), "\n").alias("text"))
    )


def read_csv_by_ranges(spark: SparkSession, path: str, schema: T.StructType = REVIEW_SCHEMA, header: bool = True) -> DataFrame:
    """The rows of :func:`plaudit.sources.reviews.read_reviews_csv`, from as many tasks as the files have byte ranges."""
    records = csv_records(spark, path)
    if header:
        records = records.where("not (at = 0 and place = 0)")
    # As in the other reader, a break inside quotes is a line feed where lines end with a carriage return and one.
    ended = F.col("text").endswith("\r")
    text = F.when(ended, F.replace(F.regexp_replace("text", r"\r$", ""), F.lit("\r\n"), F.lit("\n"))).otherwise(F.col("text"))
    filled = records.select(text.alias("text")).where("text <> ''")  # empty lines are no records
    options = {"quote": '"', "escape": '"', "multiLine": "true"}
    return filled.select(F.from_csv("text", schema.simpleString()[7:-1].replace(":", " "), options).alias("r")).select("r.*")
