"""Sum-of-squares online packing of token sequences into windows.

Each task packs the documents of its own input, in order. A document is cut at full windows; its
rest goes to the fill level that makes the sum of squared counts of partly filled windows smallest.
The counts stand in an array by level. Windows still open at the end are joined piece by piece into
full ones, and the last is cut at powers of two, which need no padding; so nothing is padded.
"""

from __future__ import annotations

import itertools
import os
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F
from tokenizers import Tokenizer

from plaudit.llm import arrays as A

LENGTH = 2048
END = 1
# Pieces whose ids a worker remembers in each of two generations, open windows of a task, and bytes
# of text worked on at once; these only bound memory.
MEMO = 400_000
OPEN_WINDOWS = 4096
BLOCK_BYTES = 1 << 22
# Letters, then ASCII symbols to the end. The apostrophe is left out, which a tokenizer may take
# together with letters, and a capital I with a dot, whose lower case ends in a mark like a symbol.
LETTERS_SYMBOLS = "^(\\pL*[^\\PL\u0130])([!-&(-/:-@\\[-`{-~]+)$"

_chunks: dict[str, Chunks] = {}


class Chunks:
    """A tokenizer and the ids, as bytes, of the pieces of text that it met last."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark uses all cores already
        self.tokenizer = Tokenizer.from_file(path)
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def ids(self, pieces: list[str]) -> list[bytes]:
        """The ids of each of some distinct pieces; what is not remembered is encoded."""
        found = list(map(self.young.get, pieces))
        new = []
        for i, (piece, ids) in enumerate(zip(pieces, found, strict=True)):
            if ids is None:
                if piece in self.old:
                    found[i] = self.young[piece] = self.old[piece]
                else:
                    new.append(i)
        for start in range(0, len(new), 10_000):
            some = new[start : start + 10_000]
            encoded = self.tokenizer.encode_batch_fast([pieces[i] for i in some], add_special_tokens=False)
            for i, one in zip(some, encoded, strict=True):
                found[i] = self.young[pieces[i]] = array("I", one.ids).tobytes()
        if len(self.young) > MEMO:
            self.young, self.old = {}, (self.young if len(self.young) <= 2 * MEMO else {})
        return found


def _spread(sizes: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs of ``sizes`` items lie one after another: the places of the runs ``which``, and their bounds."""
    firsts, chosen = np.cumsum(sizes) - sizes, sizes[which]
    bounds = np.concatenate(([0], np.cumsum(chosen)))
    return np.repeat(firsts[which] - bounds[:-1], chosen) + np.arange(bounds[-1]), bounds


def token_ids(texts: pa.Array, path: str) -> Iterator[np.ndarray]:
    """The ids of each text, without special tokens; a null is empty.

    The tokenizer drops white space and never joins across it, and takes a run of letters apart from
    the symbols behind it. So each such piece is encoded once and remembered for a while.
    """
    if path not in _chunks:
        _chunks[path] = Chunks(path)
    words = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
    chunks = words.flatten().dictionary_encode()
    parts = pc.ascii_split_whitespace(pc.replace_substring_regex(chunks.dictionary, LETTERS_SYMBOLS, "\\1 \\2"))
    pieces = parts.flatten().dictionary_encode()
    found = _chunks[path].ids(pieces.dictionary.to_pylist())
    flat = np.frombuffer(b"".join(found), np.uint32)
    sizes = np.fromiter(map(len, found), np.int64, len(found)) // 4
    at, bounds = _spread(sizes, pieces.indices.to_numpy(zero_copy_only=False))
    by_chunk = bounds[parts.offsets.to_numpy()]
    of_words, bounds = _spread(np.diff(by_chunk), chunks.indices.to_numpy(zero_copy_only=False))
    ids = flat[at][of_words]
    for start, stop in itertools.pairwise(bounds[words.offsets.to_numpy()].tolist()):
        yield ids[start:stop]


class Levels:
    """Open windows by fill level, and the rule that picks one."""

    def __init__(self, length: int):
        self.length = length
        self.counts = np.zeros(length + 1, np.int64)  # the level array; 0 and full stay 0
        self.open: list[list[list]] = [[] for _ in range(length)]
        self.total = 0

    def place(self, piece) -> list | None:
        """Put a piece (its ids come last) into a window; the window if that is now full."""
        size = len(piece[-1])
        n = self.counts
        # Levels 1 .. length - size change by -2n + 1 there, and +2n + 1 where they rise to.
        levels = np.arange(0, self.length - size + 1)
        change = 2 * n[levels + size] + 1
        change[1:] += 1 - 2 * n[levels[1:]]
        if levels[-1] + size == self.length:  # a full window counts no more
            change[-1] -= 2 * n[self.length] + 1
        change[1:][n[levels[1:]] == 0] = np.iinfo(np.int64).max
        level = int(len(change) - 1 - np.argmin(change[::-1]))  # of ties the fullest
        window = self.open[level].pop() if level else []
        window.append(piece)
        if level:
            n[level] -= 1
            self.total -= 1
        if level + size == self.length:
            return window
        n[level + size] += 1
        self.open[level + size].append(window)
        self.total += 1
        return None

    def rest(self) -> Iterator[list]:
        """Close all: pieces of open windows, fullest first, cut into full windows and powers of two."""
        pieces = [piece for level in reversed(self.open) for window in level for piece in window]
        left = sum(len(piece[-1]) for piece in pieces)
        self.counts[:], self.total = 0, 0
        self.open = [[] for _ in range(self.length)]
        window, room = [], 0
        for doc, start, ids in pieces:
            while len(ids):
                if not room:
                    room = self.length if left >= self.length else 1 << (left.bit_length() - 1)
                part = ids[:room]
                window.append((doc, start, part))
                ids, start = ids[len(part) :], start + len(part)
                room -= len(part)
                left -= len(part)
                if not room:
                    yield window
                    window = []


def pack(
    docs: DataFrame, tokenizer: str, length: int = LENGTH, end: int = END, id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Each document is its ids and then ``end``; each of these lies in exactly one piece. A null or
    empty text is ``end`` alone; repeated rows are packed each; null ids are kept. An empty table
    gives no row. ``tokenizer`` is a file that every worker can read, of a tokenizer that drops
    white space, does not join across it, and takes letters apart from the symbols after them. ``length`` is a power of two.
    """
    schema = (
        "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    )
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = TaskContext.get().partitionId() << 40
        made, levels, rows = 0, Levels(length), []

        def emit(window: list) -> None:
            nonlocal made
            offset = 0
            for (doc_id, size), start, ids in window:
                rows.append((doc_id, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), size, base + made, offset))
                offset += len(ids)
            made += 1

        def out() -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True)) or [[]] * 7
            rows.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names)

        for batch in A.blocks(batches, limit=BLOCK_BYTES):
            for doc_id, found in zip(batch.column("doc_id").to_pylist(), token_ids(batch.column("text"), tokenizer), strict=True):
                ids = np.append(found, np.uint32(end))
                doc = (doc_id, len(ids))
                whole = len(ids) // length * length
                for start in range(0, whole, length):
                    emit([(doc, start, ids[start : start + length])])
                if whole < len(ids):
                    full = levels.place((doc, whole, ids[whole:].copy()))
                    if full is not None:
                        emit(full)
                if levels.total > OPEN_WINDOWS:
                    for window in levels.rest():
                        emit(window)
            yield out()
        for window in levels.rest():
            emit(window)
        yield out()

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, schema)
