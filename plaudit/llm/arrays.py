"""Whole texts as byte arrays: words, hashes and shingles of an Arrow batch at once."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# White space of the contracts: blank and U+0009 to U+000D.
SPACES = bytes([32, 9, 10, 11, 12, 13])
# Bytes of text worked on at once; a longer text is worked on alone and whole.
BLOCK_BYTES = 1 << 19
_ODD = np.uint64(0x9E3779B97F4A7C15)


def lowered_table(separators: bytes) -> np.ndarray:
    """Byte to byte: A-Z in lower case, separators to 0. Byte 0 is a separator or becomes 255."""
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    table[0] = 255
    table[list(separators)] = 0
    return table


# Words without white space, and words of letters, digits and everything outside ASCII.
SPACED = lowered_table(SPACES)
ALNUM = lowered_table(bytes(b for b in range(128) if not (48 <= b < 58 or 65 <= b < 91 or 97 <= b < 123)))


def blocks(
    batches: Iterable[pa.RecordBatch], column: str = "text", limit: int = BLOCK_BYTES
) -> Iterator[pa.RecordBatch]:
    """The rows in order, as batches whose texts take ``limit`` bytes at most, or one row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(sizes, dtype=np.int64)
        start = 0
        while start < batch.num_rows:
            base = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, base + limit, "right")))
            yield batch.slice(start, stop - start)
            start = stop


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of the texts one after another, and n + 1 bounds; a null is empty."""
    texts = pc.fill_null(texts, "")
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    _, offsets, data = texts.buffers()
    bounds = np.frombuffer(offsets, kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[bounds[0] : bounds[-1]], bounds - bounds[0]


@dataclass
class Words:
    """Words of many texts: byte spans in ``data``, which is translated, and bounds by text."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    bounds: np.ndarray  # words of text i: bounds[i] to bounds[i + 1]

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.bounds)

    @property
    def texts(self) -> np.ndarray:
        """The text number of each word."""
        return np.repeat(np.arange(len(self.bounds) - 1), self.counts)

    def word(self, i: int) -> bytes:
        return self.data[self.starts[i] : self.ends[i]].tobytes()


def split_words(raw: np.ndarray, bounds: np.ndarray, table: np.ndarray) -> Words:
    data = table[raw]
    inside = data != 0
    first = np.zeros(len(data) + 1, bool)
    first[bounds] = True
    before = np.concatenate(([False], inside[:-1])) if len(data) else inside
    after = np.concatenate((inside[1:], [False])) if len(data) else inside
    starts = np.flatnonzero(inside & (~before | first[:-1]))
    ends = np.flatnonzero(inside & (~after | first[1:])) + 1
    return Words(data, starts, ends, np.searchsorted(starts, bounds))


def words_of(texts: pa.Array, table: np.ndarray = SPACED) -> Words:
    return split_words(*text_bytes(texts), table)


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


_powers: list[np.ndarray] = []


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse modulo 2**64; kept as long as the worker lives."""
    if not _powers or len(_powers[0]) < n:
        base, inverse = np.uint64(0x5851F42D4C957F2D), np.uint64(pow(0x5851F42D4C957F2D, -1, 1 << 64))
        size = max(n, BLOCK_BYTES + 1)
        made = []
        for factor in (base, inverse):
            steps = np.full(size, factor, np.uint64)
            steps[0] = 1
            made.append(np.cumprod(steps))
        if size > 4 * BLOCK_BYTES:  # of one very long text; not kept
            return made[0], made[1]
        _powers[:] = made
    return _powers[0], _powers[1]


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte span: a polynomial from prefix sums, then mixed."""
    up, down = _power_tables(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=sums[1:])
    h = (sums[ends] - sums[starts]) * down[starts]
    return mix(h + (ends - starts).astype(np.uint64) * _ODD)


def word_hashes(words: Words) -> np.ndarray:
    return span_hashes(words.data, words.starts, words.ends)


def run_hashes(hashes: np.ndarray, size: int) -> np.ndarray:
    """A hash of each run of ``size`` words, by the place of its first word."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.full(n, np.uint64(size), np.uint64)
    for k in range(size):
        out = (out + hashes[k : k + n]) * _ODD
        out ^= out >> np.uint64(31)
    return mix(out)


def shingles(hashes: np.ndarray, bounds: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Every run of ``size`` words inside a text: hash, text number and first word's place.

    A text of fewer words, but not none, is one run.
    """
    counts = np.diff(bounds)
    texts = np.repeat(np.arange(len(counts)), np.maximum(counts - size + 1, 0))
    firsts = np.repeat(bounds[:-1], np.maximum(counts - size + 1, 0))
    within = np.arange(len(texts)) - np.repeat(
        np.concatenate(([0], np.cumsum(np.maximum(counts - size + 1, 0))))[:-1], np.maximum(counts - size + 1, 0)
    )
    places = firsts + within
    found = run_hashes(hashes, size)[places] if len(places) else np.zeros(0, np.uint64)
    for short in range(1, size):
        which = np.flatnonzero(counts == short)
        if len(which):
            found = np.concatenate((found, run_hashes(hashes, short)[bounds[which]]))
            texts = np.concatenate((texts, which))
            places = np.concatenate((places, bounds[which]))
    return found, texts, places


def signed(hashes: np.ndarray) -> np.ndarray:
    return hashes.view(np.int64)
