"""Short codes of vectors: each part of a vector is the number of its nearest codebook entry.

Codebooks are learned by rounds of exact k-means on whole numbers. Every row keeps, for each part,
an upper bound on the distance to its entry and a lower bound on the distance to each group of the
other entries, each with the round in which it was exact. All codebooks so far are kept, so a bound
of round s is carried to round t by the length of the true way that an entry went from s to t (the
norm of the sum of its moves), which is never more than the moves added up one by one. Only where
the bounds do not decide are distances computed again, to the groups in question.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from plaudit.llm import vectors as V
from plaudit.plans.session import durable, durable_files, remove_durable, ship_package

PARTS = 4
ENTRIES = 256  # two hex digits
ROUNDS = 4
SCALE = 1024
GROUP = 32  # entries that share a lower bound
LIMIT = 1 << 28  # so that squares of differences add up in a long
SLICE = 32  # entries whose sums travel in one row
# Bounds are doubles and floats; a decision needs more than this share between them.
SLACK = 1e-6
STATE = "vec_id long, label int, x array<long>, codes binary, bounds binary"
# Labels that are broadcast at most; with more of them their sums are joined by shuffle.
BROADCAST_LABELS = 100_000


def distances(x: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Squared distances of rows to entries, exact, as whole numbers."""
    size = max(np.abs(x).max(initial=0), np.abs(entries).max(initial=0))
    if 4 * float(size) ** 2 * x.shape[1] < 1 << 53:  # every sum is a whole number that a double holds
        a, b = x.astype(np.float64), entries.astype(np.float64)
        return ((a * a).sum(1)[:, None] - 2 * (a @ b.T) + (b * b).sum(1)).astype(np.int64)
    return np.stack([((x - entry) ** 2).sum(1) for entry in entries], 1) if len(entries) else np.zeros((len(x), 0), np.int64)


@dataclass
class Part:
    """Of one part of many rows: entries, bounds, and the rounds in which the bounds were exact."""

    code: np.ndarray
    upper: np.ndarray
    upper_at: np.ndarray
    lower: np.ndarray  # one column a group
    lower_at: np.ndarray
    computed: int = 0  # distances


@dataclass
class History:
    """All codebooks of one part, and how far entries and groups went since each of them."""

    books: list[np.ndarray]
    moved: np.ndarray = field(init=False)  # round, entry
    most: np.ndarray = field(init=False)  # round, group

    def __post_init__(self) -> None:
        now = self.books[-1]
        self.moved = np.array([np.sqrt(((now - book).astype(np.float64) ** 2).sum(1)) for book in self.books])
        self.most = np.maximum.reduceat(self.moved, np.arange(0, len(now), GROUP), axis=1)

    @property
    def round(self) -> int:
        return len(self.books) - 1


def _nearest(squares: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The first smallest of each row, its value, and the smallest of the others (the largest long if none)."""
    rows = np.arange(len(squares))
    best = squares.argmin(1)
    least = squares[rows, best]
    if squares.shape[1] == 1:
        return best, least, np.full(len(squares), np.iinfo(np.int64).max)
    rest = squares.copy()
    rest[rows, best] = np.iinfo(np.int64).max
    return best, least, rest.min(1)


def assign_first(x: np.ndarray, history: History) -> Part:
    """Distances to all entries; every bound is exact."""
    book, t = history.books[-1], history.round
    n, groups = len(x), -(-len(book) // GROUP)
    squares = distances(x, book)
    code = squares.argmin(1) if n else np.zeros(0, np.int64)
    rows = np.arange(n)
    upper = np.sqrt(squares[rows, code].astype(np.float64))
    squares[rows, code] = np.iinfo(np.int64).max
    lower = np.sqrt(np.minimum.reduceat(squares, np.arange(0, len(book), GROUP), axis=1).astype(np.float64))
    at = np.full((n, groups), t, np.uint8)
    return Part(code, upper, np.full(n, t, np.uint8), _down(lower), at, n * len(book))


def _down(lower: np.ndarray) -> np.ndarray:
    """As floats, none larger than it was."""
    return np.nextafter(lower.astype(np.float32), np.float32(-1))


def assign_again(x: np.ndarray, was: Part, history: History) -> Part:
    """The nearest entries of the last codebook, the first of equals, by bounds as far as they decide."""
    book, t = history.books[-1], history.round
    n, groups = was.lower.shape
    upper = was.upper + history.moved[was.upper_at, was.code]
    lower = was.lower - history.most[was.lower_at, np.arange(groups)]
    out = Part(was.code.copy(), was.upper.copy(), was.upper_at.copy(), was.lower.copy(), was.lower_at.copy())

    def open_groups(upper: np.ndarray, lower: np.ndarray) -> np.ndarray:
        return lower * (1 - SLACK) <= upper[:, None] * (1 + SLACK) + SLACK

    rows = np.flatnonzero(open_groups(upper, lower).any(1))
    if not len(rows):
        return out
    # First the upper bound: the exact distance to the row's own entry.
    own = ((x[rows] - book[was.code[rows]]) ** 2).sum(1)
    exact = np.sqrt(own.astype(np.float64))
    out.upper[rows], out.upper_at[rows] = exact, t
    out.computed += len(rows)
    unsure = open_groups(exact, lower[rows])
    again = unsure.any(1)
    rows, own, exact, unsure = rows[again], own[again], exact[again], unsure[again]
    if not len(rows):
        return out
    # Then the groups that may hold a nearer one.
    best, least = was.code[rows].copy(), own.copy()
    firsts, seconds = {}, {}
    for group in range(groups):
        which = np.flatnonzero(unsure[:, group])
        if not len(which):
            continue
        entries = book[group * GROUP : (group + 1) * GROUP]
        place, value, second = _nearest(distances(x[rows[which]], entries))
        out.computed += len(which) * len(entries)
        place += group * GROUP
        firsts[group], seconds[group] = (which, place, value), second
        nearer = (value < least[which]) | ((value == least[which]) & (place < best[which]))
        best[which[nearer]], least[which[nearer]] = place[nearer], value[nearer]
    out.code[rows], out.upper[rows] = best, np.sqrt(least.astype(np.float64))
    changed = best != was.code[rows]
    # The entry that a row leaves now counts in its group's bound.
    left = rows[changed]
    group = was.code[left] // GROUP
    carried = np.minimum(lower[left, group], exact[changed])
    out.lower[left, group], out.lower_at[left, group] = _down(carried), t
    for group, (which, place, value) in firsts.items():
        others = np.where(place == best[which], seconds[group], value)
        out.lower[rows[which], group] = _down(np.sqrt(others.astype(np.float64)))
        out.lower_at[rows[which], group] = t
    return out


# --- rows of the state -----------------------------------------------------------------------------


def _packed(parts: list[Part]) -> tuple[pa.Array, pa.Array]:
    """Codes, and bounds with their rounds, of each row."""
    n = len(parts[0].code)
    codes = np.stack([p.code.astype(np.uint8) for p in parts], 1)
    fields = [np.ascontiguousarray(column).view(np.uint8).reshape(n, -1) for p in parts
              for column in (p.upper.reshape(n, 1), p.upper_at.reshape(n, 1), p.lower, p.lower_at)]
    return tuple(_binary(np.concatenate(some, 1)) for some in ([codes], fields))


def _binary(rows: np.ndarray) -> pa.Array:
    rows = np.ascontiguousarray(rows)
    offsets = np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1]
    return pa.BinaryArray.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(offsets), pa.py_buffer(rows)])


def _bytes(column: pa.Array, n: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(n, -1)


def _unpacked(codes: pa.Array, bounds: pa.Array, parts: int, groups: int) -> list[Part]:
    n = len(codes)
    held, raw, at, out = _bytes(codes, n), _bytes(bounds, n), 0, []

    def take(width: int, kind: type) -> np.ndarray:
        nonlocal at
        at += width
        return np.ascontiguousarray(raw[:, at - width : at]).view(kind)

    for p in range(parts):
        upper, upper_at = take(8, np.float64)[:, 0], take(1, np.uint8)[:, 0]
        lower, lower_at = take(4 * groups, np.float32), take(groups, np.uint8)
        out.append(Part(held[:, p].astype(np.int64), upper.copy(), upper_at.copy(), lower.copy(), lower_at.copy()))
    return out


def _assigned(rows: DataFrame, books: list[np.ndarray]) -> DataFrame:
    """Rows of STATE with the entries of the last of ``books`` (round; part, entry, position)."""
    held = rows.sparkSession.sparkContext.broadcast(books)  # fixed size: rounds, entries and width

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, entries, width = held.value[0].shape
        histories = [History([book[p] for book in held.value]) for p in range(parts)]
        for batch in batches:
            x = V.as_matrix(batch.column("x"))
            if not len(x):
                continue
            if x.shape[1] != parts * width:
                raise ValueError("vectors of several widths")
            pieces = [x[:, p * width : (p + 1) * width] for p in range(parts)]
            if len(held.value) == 1:
                found = [assign_first(piece, h) for piece, h in zip(pieces, histories, strict=True)]
            else:
                were = _unpacked(batch.column("codes"), batch.column("bounds"), parts, -(-entries // GROUP))
                found = [assign_again(piece, was, h) for piece, was, h in zip(pieces, were, histories, strict=True)]
            codes, bounds = _packed(found)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(name) for name in ("vec_id", "label", "x")), codes, bounds], ["vec_id", "label", "x", "codes", "bounds"]
            )

    return rows.mapInArrow(run, STATE)


def _moved(state: DataFrame, book: np.ndarray) -> np.ndarray:
    """The next codebook: each entry the floor of the mean of its parts; unused ones stay."""
    parts, entries, width = book.shape
    slices = -(-entries // SLICE)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((parts, slices * SLICE, 1 + width), np.int64)
        for batch in batches:
            x = V.as_matrix(batch.column("x"))
            if not len(x):
                continue
            codes = _bytes(batch.column("codes"), len(x))
            for p in range(parts):
                order = np.argsort(codes[:, p], kind="stable")
                used, first = np.unique(codes[order, p], return_index=True)
                total[p, used, 0] += np.diff(np.append(first, len(x)))
                total[p, used, 1:] += np.add.reduceat(x[order, p * width : (p + 1) * width], first)
        cut = total.reshape(parts * slices, -1)
        yield V.totals({i: cut[i] for i in np.flatnonzero(cut.any(1)).tolist()})

    found = V.added(state.select("x", "codes").mapInArrow(run, V.SUMS), np.int64, state.rdd.getNumPartitions())
    sums = np.zeros((parts * slices, SLICE, 1 + width), np.int64)
    for key, values in found.items():
        sums[key] = values.reshape(SLICE, 1 + width)
    sums = sums.reshape(parts, slices * SLICE, 1 + width)[:, :entries]
    counts = sums[:, :, :1]
    return np.where(counts > 0, sums[:, :, 1:] // np.maximum(counts, 1), book)


# --- the operator ----------------------------------------------------------------------------------


@dataclass
class Codebooks:
    """The last codebooks (part, entry, position), fixed in size by the parameters."""

    books: np.ndarray

    @property
    def sha256(self) -> str:
        """Digest of all entries' components as decimal text, by part, entry and position."""
        return hashlib.sha256(",".join(map(str, self.books.reshape(-1).tolist())).encode()).hexdigest()


def compress(
    rows: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE,
    id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
) -> tuple[DataFrame, Codebooks]:
    """vec_id, label, x (the whole-number vector), codes (a byte a part), error; and the codebooks.

    A row whose vector is null, empty or not finite is left out. Codebooks start with the rows of the
    ``entries`` smallest ids, null ids last, equal ids by their vectors; rows that repeat count as
    often as they occur, and with fewer rows there are fewer entries. An empty table gives no row.
    Widths that differ or are no multiple of ``parts`` raise ValueError, as do components
    beyond 2**28 / scale. The rows travel with their bounds: one table is written a round, and the
    one before it removed.
    """
    if not 1 <= entries <= 256:
        raise ValueError("entries must be 1 to 256")
    spark = rows.sparkSession
    ship_package(spark)
    picked = rows.select(
        F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("int").alias("label"), F.col(vector_col).alias("vector")
    )
    state = durable(V.quantised(picked, "vector", scale, LIMIT), "vector-codes")
    first = state.orderBy(F.asc_nulls_last("vec_id"), "x").select("x").limit(entries).collect()
    kinds = "vec_id long, label int, x array<long>, codes binary, error long"
    if not first:
        return spark.createDataFrame([], kinds), Codebooks(np.zeros((parts, 0, 0), np.int64))
    widths = {len(row["x"]) for row in first}
    if len(widths) > 1 or min(widths) % parts:
        raise ValueError(f"vectors of {sorted(widths)} components cannot be cut into {parts} equal parts")
    start = np.array([row["x"] for row in first], np.int64).reshape(len(first), parts, -1).transpose(1, 0, 2)
    books = [np.ascontiguousarray(start)]
    for t in range(rounds + 1):
        before, state = state, durable(_assigned(state, books), "vector-codes")
        for path in durable_files(before):
            remove_durable(spark, path)
        if t < rounds:
            books.append(_moved(state, books[-1]))
    last = spark.sparkContext.broadcast(books[-1])

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = V.as_matrix(batch.column("x"))
            codes = _bytes(batch.column("codes"), len(x))
            entry = np.concatenate([last.value[p][codes[:, p]] for p in range(parts)], 1)
            error = ((x - entry) ** 2).sum(1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(error)], [*batch.schema.names, "error"])

    return state.select("vec_id", "label", "x", "codes").mapInArrow(measure, kinds), Codebooks(books[-1])


def with_label_errors(coded: DataFrame) -> DataFrame:
    """Adds ``label_error``: the errors of all rows of the label added up; null labels are one."""
    sums = durable(coded.groupBy("label").agg(F.sum("error").alias("label_error")), "label-errors")
    small = sums.count() <= BROADCAST_LABELS
    sums = sums.withColumnRenamed("label", "_label")
    sums = F.broadcast(sums) if small else sums
    return coded.join(sums, F.col("label").eqNullSafe(F.col("_label")), "left").drop("_label")


def hex_codes(codes: str = "codes"):
    """The codes as text, two hex digits each."""
    return F.lower(F.hex(codes))


def restore(coded: DataFrame, books: Codebooks, scale: int = SCALE) -> DataFrame:
    """Adds ``restored``: the vector that the codes stand for, in the scale of the embeddings."""
    held = coded.sparkSession.sparkContext.broadcast(books.books)
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in coded.schema]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            codes = _bytes(batch.column("codes"), batch.num_rows)
            found = np.concatenate([held.value[p][codes[:, p]] for p in range(codes.shape[1])], 1)
            # A component was floored, so the middle of its step is the best guess.
            yield pa.RecordBatch.from_arrays([*batch.columns, V.as_lists((found + 0.5) / scale)], [*batch.schema.names, "restored"])

    return coded.mapInArrow(run, ", ".join([*fields, "restored array<double>"]))
