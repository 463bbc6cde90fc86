"""Line dedup: exact reference counts of lines, with sharded cuckoo filters before them.

The state is two tables. ``counts`` holds, per key of a line, the number of documents with it; that
is exact and decides. ``filters`` holds one cuckoo filter per shard of keys, with the keys that are
at or over the limit now. Adding documents adds to the counts, removing them subtracts; keys that
cross the limit enter or leave the filter of their shard. So removing what was added gives back the
state as it was. Cleaning asks the filters first: only lines that one of them knows meet the exact
table.

Keys are 128-bit digests of the normalised line; the shard of a key is part of its digest.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from plaudit.llm import arrays as A
from plaudit.llm.rows import row_key
from plaudit.plans.session import durable

LIMIT = 10
MIN_CHARS = 1
# Keys per filter that the number of shards aims at, and slots per bucket.
SHARD_KEYS = 20_000
SLOTS = 4
SALTS = 8


def line_key(line: bytes) -> bytes:
    """A line as compared: white space stripped at both ends, A-Z in lower case."""
    return line.strip(A.SPACES).lower()


def _long_enough(key: bytes, least: int) -> bool:
    return len(key) >= least and (len(key) >= 4 * least or len(key.decode("utf-8", "replace")) >= least)


def _digest(key: bytes) -> bytes:
    return hashlib.blake2b(key, digest_size=16).digest()


# --- the filter ----------------------------------------------------------------------------------


class CuckooFilter:
    """Buckets of four 16-bit fingerprints; a key may lie in either of two buckets.

    Sums of what is kept: every inserted key is found until it is deleted. A full filter grows to
    twice its buckets, from the keys it was given (the caller keeps them exactly).
    """

    def __init__(self, slots: np.ndarray):
        self.slots = slots  # shape (buckets, SLOTS), 0 is free

    @classmethod
    def of(cls, keys: list[bytes]) -> CuckooFilter:
        buckets = 1 << max(2, int(len(keys) / (SLOTS * 0.8)).bit_length())
        while True:
            made = cls(np.zeros((buckets, SLOTS), np.uint16))
            if all(made.insert(key) for key in keys):
                return made
            buckets *= 2

    @classmethod
    def load(cls, blob: bytes) -> CuckooFilter:
        return cls(np.frombuffer(blob, np.uint16).reshape(-1, SLOTS).copy())

    def dump(self) -> bytes:
        return self.slots.tobytes()

    @staticmethod
    def _print(digest: bytes) -> int:
        return int.from_bytes(digest[:2], "little") or 1

    def _pair(self, digest: bytes) -> tuple[int, int, int]:
        mark = self._print(digest)
        first = int.from_bytes(digest[2:8], "little") % len(self.slots)
        return mark, first, self._other(first, mark)

    def _other(self, bucket: int, mark: int) -> int:
        return bucket ^ (mark * 0x5BD1E995 % len(self.slots))

    def insert(self, digest: bytes) -> bool:
        mark, first, second = self._pair(digest)
        bucket = first
        for turn in range(500):
            for at in (first, second) if turn == 0 else (bucket,):
                free = np.flatnonzero(self.slots[at] == 0)
                if len(free):
                    self.slots[at, free[0]] = mark
                    return True
            place = (mark + turn) % SLOTS  # put one out and move it to its other bucket
            mark, self.slots[bucket, place] = int(self.slots[bucket, place]), mark
            bucket = self._other(bucket, mark)
        return False

    def delete(self, digest: bytes) -> bool:
        mark, first, second = self._pair(digest)
        for at in (first, second):
            held = np.flatnonzero(self.slots[at] == mark)
            if len(held):
                self.slots[at, held[0]] = 0
                return True
        return False

    def holds(self, digests: np.ndarray) -> np.ndarray:
        """For rows of 16 bytes, whether the key may be inside."""
        marks = digests[:, :2].copy().view("<u2")[:, 0].astype(np.int64)
        marks[marks == 0] = 1
        wide = np.zeros((len(digests), 8), np.uint8)
        wide[:, :6] = digests[:, 2:8]
        first = (wide.view("<u8")[:, 0] % np.uint64(len(self.slots))).astype(np.int64)
        second = first ^ (marks * 0x5BD1E995 % len(self.slots))
        return (self.slots[first] == marks[:, None]).any(1) | (self.slots[second] == marks[:, None]).any(1)


# --- the state -----------------------------------------------------------------------------------


@dataclass
class LineIndex:
    """Exact counts (key binary, docs long) and filters (shard long, filter binary)."""

    counts: DataFrame
    filters: DataFrame
    shards: int
    limit: int


def document_keys(docs: DataFrame, text_col: str = "text", least: int = MIN_CHARS) -> DataFrame:
    """row_key, key: the distinct keys of every document."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in A.blocks(batches):
            rows, keys = [], []
            for row, text in zip(batch.column("row_key").to_pylist(), batch.column("text").to_pylist(), strict=True):
                lines = {line_key(line) for line in (text or "").encode().split(b"\n")}
                found = [_digest(line) for line in lines if _long_enough(line, least)]
                rows += [row] * len(found)
                keys += found
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int64()), pa.array(keys, pa.binary())], ["row_key", "key"])

    return docs.select("row_key", F.col(text_col).alias("text")).mapInArrow(cut, "row_key long, key binary")


def _shard(shards: int):
    return F.pmod(F.xxhash64("key"), F.lit(shards))


def _counted(keys: DataFrame) -> DataFrame:
    return keys.groupBy("key").agg(F.count(F.lit(1)).alias("docs"))


def _with_rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.col(text_col)
    return docs.select(F.col(id_col).alias("doc_id"), text.alias("text"), row_key(F.col(id_col), text).alias("row_key"))


def _build(hot: DataFrame, shards: int) -> DataFrame:
    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        made = CuckooFilter.of(sorted(pdf["key"]))
        return pd.DataFrame({"shard": [pdf["shard"].iloc[0]], "filter": [made.dump()]})

    return hot.select(_shard(shards).alias("shard"), "key").groupBy("shard").applyInPandas(build, "shard long, filter binary")


def build_index(
    docs: DataFrame, limit: int = LIMIT, least: int = MIN_CHARS, id_col: str = "doc_id", text_col: str = "text",
    shards: int | None = None,
) -> LineIndex:
    """Counts and filters of a corpus. Shards follow the number of repeated keys, so none is large."""
    keys = document_keys(_with_rows(docs, id_col, text_col), least=least)
    counts = durable(_counted(keys), "line-counts")
    hot = counts.where(F.col("docs") >= limit)
    shards = shards or 1 + hot.count() // SHARD_KEYS
    return LineIndex(counts, durable(_build(hot, shards), "line-filters"), shards, limit)


def _changed(index: LineIndex, docs: DataFrame, sign: int, least: int, id_col: str, text_col: str) -> LineIndex:
    delta = _counted(document_keys(_with_rows(docs, id_col, text_col), least=least))
    joined = index.counts.alias("c").join(delta.withColumnRenamed("docs", "more").alias("d"), "key", "full_outer")
    before = F.coalesce("docs", F.lit(0))
    after = before + sign * F.coalesce("more", F.lit(0))
    moved = durable(joined.select("key", before.alias("before"), after.alias("docs")), "line-counts")
    limit = index.limit
    crossing = moved.where((F.col("before") >= limit) != (F.col("docs") >= limit)).select(
        _shard(index.shards).alias("shard"), "key", (F.col("docs") >= limit).alias("enters"),
    )
    # Held keys come along, so that a filter that is full can grow.
    held = moved.where((F.col("before") >= limit) & (F.col("docs") >= limit)).select(
        _shard(index.shards).alias("shard"), "key", F.lit(None).cast("boolean").alias("enters"),
    )

    def update(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        shard = int((left if len(left) else right)["shard"].iloc[0])
        made = CuckooFilter.load(left["filter"].iloc[0]) if len(left) else CuckooFilter.of([])
        if len(right):
            for key in sorted(right.loc[right["enters"].eq(False), "key"]):
                made.delete(key)
            if not all(made.insert(key) for key in sorted(right.loc[right["enters"].eq(True), "key"])):
                made = CuckooFilter.of(sorted(right.loc[~right["enters"].eq(False), "key"]))
        return pd.DataFrame({"shard": [shard], "filter": [made.dump()]})

    filters = (
        index.filters.groupBy("shard").cogroup(crossing.unionByName(held).groupBy("shard"))
        .applyInPandas(update, "shard long, filter binary")
    )
    counts = moved.where("docs > 0").select("key", "docs")
    return LineIndex(counts, durable(filters, "line-filters"), index.shards, limit)


def add_documents(index, docs, least: int = MIN_CHARS, id_col: str = "doc_id", text_col: str = "text") -> LineIndex:
    """The index after inserting documents."""
    return _changed(index, docs, 1, least, id_col, text_col)


def remove_documents(index, docs, least: int = MIN_CHARS, id_col: str = "doc_id", text_col: str = "text") -> LineIndex:
    """The index after deleting documents that were added before."""
    return _changed(index, docs, -1, least, id_col, text_col)


# --- cleaning ------------------------------------------------------------------------------------


def _probe(keys: DataFrame, index: LineIndex, salts: int) -> DataFrame:
    """The (row_key, key) pairs whose key a filter may hold. Each shard's filter comes before its
    keys, so a task holds one filter at a time and streams the keys past it."""
    dealt = keys.select(
        _shard(index.shards).alias("shard"), F.pmod("row_key", F.lit(salts)).alias("salt"), "row_key", "key",
        F.lit(None).cast("binary").alias("filter"),
    )
    filters = index.filters.select(
        "shard", F.explode(F.expr(f"sequence(0L, {salts - 1}L)")).alias("salt"),
        F.lit(None).cast("long").alias("row_key"), F.lit(None).cast("binary").alias("key"), "filter",
    )

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, None
        for batch in batches:
            shards = batch.column("shard").to_numpy()
            salted = batch.column("salt").to_numpy()
            blobs = batch.column("filter")
            cuts = np.flatnonzero((np.diff(shards) != 0) | (np.diff(salted) != 0)) + 1
            for start, stop in zip([0, *cuts], [*cuts, batch.num_rows], strict=True):
                if start == stop:
                    continue
                if (shards[start], salted[start]) != now:
                    now, held = (shards[start], salted[start]), None
                if blobs[int(start)].is_valid:
                    held = CuckooFilter.load(blobs[int(start)].as_py())
                    start += 1
                part = batch.slice(start, stop - start)
                if held is None or not part.num_rows:
                    continue
                digests = np.frombuffer(b"".join(part.column("key").to_pylist()), np.uint8).reshape(-1, 16)
                yield part.filter(pa.array(held.holds(digests))).select(["row_key", "key"])

    return (
        dealt.unionByName(filters)
        .repartition("shard", "salt")
        .sortWithinPartitions("shard", "salt", F.col("filter").isNull())
        .mapInArrow(probe, "row_key long, key binary")
    )


def drop_repeated_lines(
    docs: DataFrame, index: LineIndex, least: int = MIN_CHARS, id_col: str = "doc_id", text_col: str = "text",
    salts: int = SALTS,
) -> DataFrame:
    """doc_id, text, n_lines, n_dropped: every document without the lines found in ``limit``
    documents or more.

    Null or empty texts are one empty line, and stay; a text that loses all lines becomes ''. Keys
    under ``least`` code points are never dropped. Repeated rows count as documents of their own
    and are cleaned alike. Null ids, empty tables and other columns do no harm.
    """
    rows = _with_rows(docs, id_col, text_col)
    hot = index.counts.where(F.col("docs") >= index.limit).select("key")
    dropped = (
        _probe(document_keys(rows, least=least).distinct(), index, salts)
        .join(hot, "key")
        .groupBy("row_key")
        .agg(F.collect_list("key").alias("keys"))
    )

    def strip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in A.blocks(batches):
            texts, totals, lost = [], [], []
            for text, keys in zip(batch.column("text").to_pylist(), batch.column("keys").to_pylist(), strict=True):
                lines = (text or "").encode().split(b"\n")
                gone = set(keys or ())
                kept = [line for line in lines if _digest(line_key(line)) not in gone] if gone else lines
                texts.append(b"\n".join(kept).decode())
                totals.append(len(lines))
                lost.append(len(lines) - len(kept))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(texts, pa.string()), pa.array(totals, pa.int64()), pa.array(lost, pa.int64())],
                ["doc_id", "text", "n_lines", "n_dropped"],
            )

    kind = dict(rows.dtypes)["doc_id"]
    return rows.join(dropped, "row_key", "left").select("doc_id", "text", "keys").mapInArrow(
        strip, f"doc_id {kind}, text string, n_lines long, n_dropped long"
    )
