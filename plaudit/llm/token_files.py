"""Token ids in compressed binary files: canonical Huffman codes of limited length.

Texts are tokenised once into a written table. The counts of all ids over all documents give one
code; its lengths, no longer than a limit, are found by package-merge and stored, and the code words
follow from the lengths. Documents are dealt out by id into files in ascending order; a file is rows
of independent blocks. A block, all numbers little-endian:

    4 bytes  "HUFB"
    uint32   documents            uint64  ids            uint64  bits of code
    uint32   ids between two checkpoints
    uint32   width of a checkpoint in bytes, 4 or 8
    int64    id of each document, then a byte of each: 1 if it has an id
    uint64   ids of each document
    the bit where each checkpoint's ids begin
    the code words, first bit highest, and 8 bytes of zeros

A reader looks up the next bits in a table of all code words and so decodes all stretches between
checkpoints side by side, or, for some ids of a block, only the stretches that hold them.
"""

from __future__ import annotations

import itertools
import json
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from plaudit.llm import arrays as A
from plaudit.llm.packing import Chunks, _spread
from plaudit.plans.session import durable, durable_files, durable_path, remove_durable, ship_package

END = 0
BLOCK_IDS = 1 << 16  # a block is closed when it has so many; a document lies in one block
STRIDE = 64
MAX_LENGTH = 24  # bits of a code word; the reader takes 32 bits at once, from any bit of a byte
TEXT_BYTES = 1 << 22
_MAGIC = b"HUFB"
_HEAD = struct.Struct("<4sIQQII")
TOKENS = "doc_id long, place long, n long, ids binary"
BLOCKS = "file int, block int, n_docs long, n_ids long, first long, payload binary"

# --- ids of texts ----------------------------------------------------------------------------------

# White space outside ASCII, where pieces may end elsewhere than this module cuts; such texts are encoded whole.
WIDE_SPACE = "[\\x{1c}-\\x{1f}\\x{85}\\x{a0}\\x{1680}\\x{180e}\\x{2000}-\\x{200b}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}\\x{feff}]"
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True
_SYMBOL = np.zeros(256, bool)
_SYMBOL[[b for b in range(33, 127) if not _LETTER[b]]] = True

_coders: dict[str, Coder] = {}


def piece_starts(raw: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Where texts may be cut so that a byte-level tokenizer gives the same ids for the parts.

    Such a tokenizer takes a blank with what follows it, leaves the last of several white spaces for
    what follows, and ends a run of letters at anything else.
    """
    n = len(raw)
    space = _SPACE[raw]
    first = np.zeros(n + 1, bool)
    first[bounds] = True
    before = np.zeros(n, bool)  # white space before, in the same text
    before[1:] = space[:-1]
    before &= ~first[:-1]
    after = np.ones(n, bool)  # white space or the end behind
    after[:-1] = space[1:]
    after |= first[1:]
    cut = first[:-1] | (space & ~before) | (space & ~after)
    blank = np.zeros(n, bool)
    blank[1:] = raw[:-1] == 32
    cut |= ~space & before & ~blank
    letter = np.zeros(n, bool)
    letter[1:] = _LETTER[raw[:-1]]
    return np.flatnonzero(cut | (_SYMBOL[raw] & letter))


class Coder:
    """A tokenizer, with a memory of the pieces met last if texts may be cut for it."""

    def __init__(self, path: str):
        self.chunks = Chunks(path)
        self.tokenizer = self.chunks.tokenizer
        with open(path, encoding="utf-8") as file:
            made = json.load(file)
        split = made.get("pre_tokenizer") or {}
        plain = split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space")
        self.cuts = plain and made.get("normalizer") is None
        added = [token["content"] for token in made.get("added_tokens", ())]
        self.whole = "|".join([WIDE_SPACE, *(f"\\Q{token}\\E" for token in added)])

    @property
    def vocabulary(self) -> int:
        return self.tokenizer.get_vocab_size(with_added_tokens=True)

    def ids(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after another, and how many each text has; a null is empty."""
        texts = pc.fill_null(texts, "")
        if not self.cuts:
            whole = np.ones(len(texts), bool)
        else:
            whole = pc.match_substring_regex(texts, self.whole).to_numpy(zero_copy_only=False)
        raw, bounds = A.text_bytes(pc.if_else(pa.array(whole), "", texts))
        starts = piece_starts(raw, bounds)
        offsets = np.append(starts, len(raw)).astype(np.int32)
        pieces = pa.StringArray.from_buffers(len(starts), pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(raw)))
        pieces = pieces.dictionary_encode()
        found = self.chunks.ids(pieces.dictionary.to_pylist())
        sizes = np.fromiter(map(len, found), np.int64, len(found)) // 4
        at, ends = _spread(sizes, pieces.indices.to_numpy(zero_copy_only=False))
        ids = np.frombuffer(b"".join(found), np.uint32)[at]
        cuts = ends[np.searchsorted(starts, bounds)]
        if not whole.any():
            return ids, np.diff(cuts)
        parts, counts = np.split(ids, cuts[1:-1]), np.diff(cuts)
        places = np.flatnonzero(whole)
        encoded = self.tokenizer.encode_batch_fast(texts.take(pa.array(places)).to_pylist(), add_special_tokens=False)
        for place, one in zip(places.tolist(), encoded, strict=True):
            parts[place] = np.array(one.ids, np.uint32)
            counts[place] = len(parts[place])
        return np.concatenate(parts), counts


def coder(path: str) -> Coder:
    """The tokenizer of a file, loaded once per worker."""
    if path not in _coders:
        _coders[path] = Coder(path)
    return _coders[path]


def tokenise(
    docs: DataFrame, tokenizer: str, end: int = END, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Rows of TOKENS: each document's ids and ``end``, packed, and a place that no other row has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = TaskContext.get().partitionId() << 40
        for batch in A.blocks(batches, limit=TEXT_BYTES):
            found, counts = coder(tokenizer).ids(batch.column("text"))
            ids = np.insert(found, np.cumsum(counts), np.uint32(end)).astype("<u4")
            kind = "<u2" if wide <= 1 << 16 else "<u4"
            data = ids.astype(kind)
            n = counts + 1
            offsets = np.concatenate(([0], np.cumsum(n))) * data.itemsize
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"), pa.array(place + np.arange(len(n))), pa.array(n),
                    pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(n), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(data)]).cast(pa.binary()),
                ],
                ["doc_id", "place", "n", "ids"],
            )
            place += len(n)

    wide = max(coder(tokenizer).vocabulary, end + 1)
    picked = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return picked.mapInArrow(run, TOKENS)


def unpacked(ids: pa.Array, counts: np.ndarray) -> list[np.ndarray]:
    """The ids of each row of TOKENS."""
    kinds = {2: "<u2", 4: "<u4"}
    return [
        np.frombuffer(some, kinds[len(some) // n]).astype(np.uint32) for some, n in zip(ids.to_pylist(), counts.tolist(), strict=True)
    ]


def id_counts(tokens: DataFrame) -> dict[int, int]:
    """How often each id comes in all documents: as many entries as the vocabulary has at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            some = np.bincount(np.concatenate(unpacked(batch.column("ids"), batch.column("n").to_numpy())))
            if len(some) > len(total):
                some, total = total, some
            total[: len(some)] += some
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], ["id", "n"])

    parts = tokens.select("n", "ids").mapInArrow(run, "id long, n long")
    return dict(map(tuple, parts.groupBy("id").agg(F.sum("n").alias("n")).collect()))


# --- the code --------------------------------------------------------------------------------------


def code_lengths(counts: np.ndarray, limit: int) -> np.ndarray:
    """Lengths of the best prefix code whose words have ``limit`` bits at most, by package-merge."""
    n = len(counts)
    if n <= 1:
        return np.ones(n, np.int64)
    if n > 1 << limit:
        raise ValueError(f"{n} symbols cannot have code words of {limit} bits")
    order = np.argsort(counts, kind="stable")
    leaves = np.asarray(counts, np.int64)[order]
    lists, packages = [], np.zeros(0, np.int64)
    for _ in range(limit):
        merged = np.concatenate((leaves, packages))
        by_weight = np.argsort(merged, kind="stable")  # of equals leaves come first
        lists.append(by_weight < n)
        weights = merged[by_weight]
        pairs = len(weights) // 2
        packages = weights[: 2 * pairs : 2] + weights[1 : 2 * pairs : 2]
    # The first 2n - 2 items of the last list are chosen, and what its packages are made of.
    lengths, take = np.zeros(n, np.int64), 2 * n - 2
    for is_leaf in reversed(lists):
        chosen = int(is_leaf[:take].sum())
        lengths[:chosen] += 1
        take = 2 * (take - chosen)
    out = np.zeros(n, np.int64)
    out[order] = lengths
    return out


@dataclass
class Code:
    """A canonical code: ids with a code word, ascending, and the words' lengths."""

    ids: np.ndarray
    lengths: np.ndarray

    def __post_init__(self) -> None:
        order = np.lexsort((self.ids, self.lengths))
        self.bits = int(self.lengths.max(initial=1))
        spans = np.left_shift(1, self.bits - self.lengths[order])  # places of the table that a word takes
        starts = np.concatenate(([0], np.cumsum(spans)))[:-1]
        if len(spans) and starts[-1] + spans[-1] > 1 << self.bits:
            raise ValueError("these lengths are of no prefix code")
        size = int(self.ids.max(initial=-1)) + 1
        self.words, self.sizes = np.zeros(size, np.uint64), np.zeros(size, np.uint64)
        self.words[self.ids[order]] = starts >> (self.bits - self.lengths[order])
        self.sizes[self.ids] = self.lengths
        # By the next bits: the id, and how many bits its word has (0: no word begins so).
        self.table = np.zeros(1 << self.bits, np.uint32)
        self.steps = np.zeros(1 << self.bits, np.uint8)
        covered = int(spans.sum())
        self.table[:covered] = np.repeat(self.ids[order], spans)
        self.steps[:covered] = np.repeat(self.lengths[order], spans)

    @classmethod
    def of(cls, counts: dict[int, int], limit: int) -> Code:
        ids = np.array(sorted(counts), np.int64)
        return cls(ids, code_lengths(np.array([counts[i] for i in ids.tolist()], np.int64), limit))


def length_limit(symbols: int) -> int:
    """Bits of the longest word: two more than equal words would need, 12 at least."""
    return min(MAX_LENGTH, max(12, (max(symbols, 2) - 1).bit_length() + 2))


def encode_block(docs: list[tuple[int | None, np.ndarray]], code: Code, stride: int = STRIDE) -> bytes:
    """A block of whole documents, in order."""
    ids = np.concatenate([ids for _, ids in docs]) if docs else np.zeros(0, np.uint32)
    sizes = code.sizes[ids]
    ends = np.cumsum(sizes, dtype=np.uint64)
    starts = ends - sizes
    bits = int(ends[-1]) if len(ends) else 0
    at = (starts >> np.uint64(5)).astype(np.int64)
    value = code.words[ids] << (np.uint64(64) - (starts & np.uint64(31)) - sizes)
    out = np.zeros(bits // 32 + 4, np.uint64)
    if len(at):
        first = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
        # Words do not overlap, so adding is joining.
        out[at[first]] += np.add.reduceat(value >> np.uint64(32), first)
        out[at[first] + 1] += np.add.reduceat(value & np.uint64(0xFFFFFFFF), first)
    stream = out.astype(">u4").tobytes()[: (bits + 7) // 8] + bytes(8)
    width = 4 if bits < 1 << 32 else 8
    head = _HEAD.pack(_MAGIC, len(docs), len(ids), bits, stride, width)
    return b"".join([
        head, np.array([i or 0 for i, _ in docs], "<i8").tobytes(), bytes(i is not None for i, _ in docs),
        np.array([len(some) for _, some in docs], "<u8").tobytes(), starts[::stride].astype(f"<u{width}").tobytes(), stream,
    ])


class Block:
    """A block that can be read from any checkpoint."""

    def __init__(self, payload: bytes, code: Code):
        magic, docs, self.n, self.bits, self.stride, width = _HEAD.unpack_from(payload)
        if magic != _MAGIC:
            raise ValueError("not a block of token ids")
        at = _HEAD.size
        named = np.frombuffer(payload, "<i8", docs, at)
        known = np.frombuffer(payload, np.uint8, docs, at + 8 * docs)
        self.doc_ids = [i if k else None for i, k in zip(named.tolist(), known.tolist(), strict=True)]
        self.sizes = np.frombuffer(payload, "<u8", docs, at + 9 * docs).astype(np.int64)
        at += 17 * docs
        marks = -(-self.n // self.stride)
        self.marks = np.frombuffer(payload, f"<u{width}", marks, at).astype(np.int64)
        self.stream = np.frombuffer(payload, np.uint8, offset=at + width * marks)
        self.code = code

    def ids(self, start: int = 0, stop: int | None = None) -> np.ndarray:
        """Ids ``start`` to ``stop`` of the block; no other stretches are decoded."""
        stop = self.n if stop is None else min(stop, self.n)
        if start >= stop:
            return np.zeros(0, np.uint32)
        first, last = start // self.stride, -(-stop // self.stride)
        place = self.marks[first:last].copy()
        base = int(place[0]) // 8
        ahead = (int(self.marks[last]) if last < len(self.marks) else self.bits) // 8 + 5
        b = self.stream[base : min(ahead, len(self.stream))].astype(np.uint32)
        four = (b[:-3] << np.uint32(24)) | (b[1:-2] << np.uint32(16)) | (b[2:-1] << np.uint32(8)) | b[3:]
        place -= 8 * base
        out = np.zeros((len(place), self.stride), np.uint32)
        end = 8 * (len(four) - 1)
        down = np.uint32(32 - self.code.bits)
        for k in range(self.stride):
            # Stretches lie one after another: a short last one reads on into zeros, which are cut off.
            np.minimum(place, end, out=place)
            found = (four[place >> 3] << (place & 7).astype(np.uint32)) >> down
            out[:, k] = self.code.table[found]
            place += self.code.steps[found]
        return out.reshape(-1)[start - first * self.stride : stop - first * self.stride]


# --- files -----------------------------------------------------------------------------------------


def write_tokens(
    docs: DataFrame, folder: str, tokenizer: str, end: int = END, id_col: str = "doc_id", text_col: str = "text",
) -> None:
    """Writes ``folder``/code (id, length) and ``folder``/blocks (rows of BLOCKS), files in ascending id order.

    Null and empty texts are ``end`` alone. Null ids come last; documents that share an id follow
    each other, repeated rows each for itself. Very long texts make a block of their own. An empty
    table makes files without blocks. ``tokenizer`` is a file that every worker can read.
    """
    spark = docs.sparkSession
    ship_package(spark)
    tokens = durable(tokenise(docs, tokenizer, end, id_col, text_col), "token-ids")
    counts = id_counts(tokens)
    code = Code.of(counts, length_limit(len(counts)))
    lengths = list(zip(code.ids.tolist(), code.lengths.tolist(), strict=True))
    spark.createDataFrame(lengths, "id long, length int").coalesce(1).write.parquet(f"{folder}/code")
    held = spark.sparkContext.broadcast(code)  # the vocabulary and a table of 2 ** MAX_LENGTH entries bound it

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file, made, before, docs, size = TaskContext.get().partitionId(), 0, 0, [], 0

        def block() -> pa.RecordBatch:
            values = [file, made, len(docs), size, before, encode_block(docs, held.value)]
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            return pa.RecordBatch.from_arrays(
                [pa.array([v], k) for v, k in zip(values, kinds, strict=True)], ["file", "block", "n_docs", "n_ids", "first", "payload"]
            )

        for batch in batches:
            for doc_id, ids in zip(batch.column("doc_id").to_pylist(), unpacked(batch.column("ids"), batch.column("n").to_numpy()), strict=True):
                docs.append((doc_id, ids))
                size += len(ids)
                if size >= BLOCK_IDS:
                    yield block()
                    made, before, docs, size = made + 1, before + size, [], 0
        if docs:
            yield block()

    # Places set equal and null ids apart, so that no id fills a file alone.
    order = [F.asc_nulls_last("doc_id"), F.asc("place")]
    dealt = tokens.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "n", "ids")
    dealt.mapInArrow(run, BLOCKS).write.option("compression", "uncompressed").parquet(f"{folder}/blocks")
    for path in durable_files(tokens):
        remove_durable(spark, path)


def read_code(spark: SparkSession, folder: str) -> Code:
    found = spark.read.schema("id long, length int").parquet(f"{folder}/code").orderBy("id").collect()  # the vocabulary
    return Code(np.array([row["id"] for row in found], np.int64), np.array([row["length"] for row in found], np.int64))


def read_tokens(spark: SparkSession, folder: str, with_ids: bool = False) -> DataFrame:
    """doc_id, start (ids of all documents before), n_tokens, ids_crc32, and the ids if asked for."""
    ship_package(spark)
    blocks = spark.read.schema(BLOCKS).parquet(f"{folder}/blocks")
    files = blocks.groupBy("file").agg(F.sum("n_ids").alias("n")).orderBy("file").collect()  # one row a file
    sums = [0, *itertools.accumulate(row["n"] for row in files)]
    held = spark.sparkContext.broadcast((read_code(spark, folder), {row["file"]: n for row, n in zip(files, sums)}))
    names = ["doc_id", "start", "n_tokens", "ids_crc32", *["ids"] * with_ids]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, bases = held.value
        for batch in batches:
            for file, first, payload in zip(*(batch.column(name).to_pylist() for name in ("file", "first", "payload")), strict=True):
                block = Block(payload, code)
                ids = block.ids().astype("<u4")
                ends = np.cumsum(block.sizes)
                starts = ends - block.sizes
                sums = [zlib.crc32(ids[a:b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
                columns = [
                    pa.array(block.doc_ids, pa.int64()), pa.array(bases[file] + first + starts), pa.array(block.sizes), pa.array(sums, pa.int64()),
                ]
                if with_ids:
                    offsets = np.concatenate(([0], ends)).astype(np.int32)
                    columns.append(pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids.astype(np.int32))))
                yield pa.RecordBatch.from_arrays(columns, names)

    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids
    return blocks.select("file", "first", "payload").mapInArrow(run, schema)


def token_files(
    docs: DataFrame, tokenizer: str, end: int = END, folder: str | None = None, id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """Writes the files, by default in the folder that all executors share, and reads them back."""
    folder = folder or durable_path(docs.sparkSession, "token-files")
    write_tokens(docs, folder, tokenizer, end, id_col, text_col)
    return read_tokens(docs.sparkSession, folder)
