"""Quality classifier: logistic regression over hashed word n-grams, trained by FTRL-proximal.

A word gives two tokens: itself without case and trailing marks, and its style (trailing marks,
capitals, digits, whether it repeats the word before). Features are the n-grams of one and two of
each, hashed into a table of fixed size and weighted by their share of the document. Only the text
goes in.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from plaudit.llm import arrays as A
from plaudit.llm.rows import fold

BITS = 18
FOLDS = 5
# Labelled rows learned from at most; those with the smallest digests of their ids.
TRAIN_ROWS = 20_000
EPOCHS = 2
THRESHOLD = 0.3
ALPHA, BETA, L1, L2 = 1.0, 0.05, 1e-4, 1e-4

_CASED = np.arange(256, dtype=np.uint8)
_CASED[0] = 255
_CASED[list(A.SPACES)] = 0
_LOWER = A.lowered_table(A.SPACES)
_ALNUM = A.lowered_table(bytes(b for b in range(128) if not (48 <= b < 58 or 65 <= b < 91 or 97 <= b < 123))) != 0
_UPPER = (np.arange(256) >= 65) & (np.arange(256) < 91)
_DIGIT = (np.arange(256) >= 48) & (np.arange(256) < 58)


def features(texts: pa.Array, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Hashed features, four a word, and the number of words of each text."""
    raw, bounds = A.text_bytes(texts)
    words = A.split_words(raw, bounds, _CASED)
    counts = words.counts
    if not len(words.starts):
        return np.zeros((0, 4), np.int64), counts
    lower = _LOWER[raw]
    alnum = _ALNUM[raw]
    places = np.arange(len(raw))
    last = np.maximum.accumulate(np.where(alnum, places, -1))[words.ends - 1]
    core_end = np.maximum(last + 1, words.starts)
    core = A.span_hashes(lower, words.starts, core_end)
    tail = A.span_hashes(lower, core_end, words.ends)

    def inside(flags: np.ndarray) -> np.ndarray:
        sums = np.concatenate(([0], np.cumsum(flags[raw])))
        return sums[words.ends] - sums[words.starts]

    texts_of = words.texts
    follows = np.concatenate(([False], texts_of[1:] == texts_of[:-1]))
    same = follows & np.concatenate(([False], core[1:] == core[:-1]))
    shape = np.minimum(inside(_UPPER), 2) + 3 * np.minimum(inside(_DIGIT), 2) + 9 * same
    style = A.mix(tail + shape.astype(np.uint64) * np.uint64(0x2545F4914F6CDD1D))
    start = np.uint64(0x6A09E667F3BCC909)
    out = np.empty((len(core), 4), np.int64)
    for k, tokens in enumerate((core, style)):
        before = np.where(follows, np.concatenate((tokens[:1], tokens[:-1])), start)
        pair = A.mix(before * np.uint64(0x9E3779B97F4A7C15) + tokens)
        for j, h in ((2 * k, A.mix(tokens + np.uint64(2 * k + 1))), (2 * k + 1, A.mix(pair + np.uint64(2 * k + 2)))):
            out[:, j] = h >> np.uint64(64 - bits)
    return out, counts


class Ftrl:
    """Follow the regularised leader, one coordinate's rate at a time."""

    def __init__(self, size: int, alpha: float = ALPHA, beta: float = BETA, l1: float = L1, l2: float = L2):
        self.z, self.n = np.zeros(size), np.zeros(size)
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2

    def weights(self, at=slice(None)) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        shrunk = np.sign(z) * self.l1 - z
        return np.where(np.abs(z) <= self.l1, 0.0, shrunk / ((self.beta + np.sqrt(n)) / self.alpha + self.l2))

    def learn(self, at: np.ndarray, x: np.ndarray, y: float) -> None:
        w = self.weights(at)
        g = (1 / (1 + np.exp(-np.clip(w @ x, -35, 35))) - y) * x
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha * w
        self.n[at] = n + g * g


def train(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
    folds: int = FOLDS, rows: int = TRAIN_ROWS, epochs: int = EPOCHS, bits: int = BITS,
) -> np.ndarray:
    """The weights, the bias last. Learns from labelled rows outside fold 0, ``rows`` at most.

    A null label or id is left out; of labels that differ the smaller counts. Without labels all
    weights are 0. The sample has a bounded size, so one task may take it in order.
    """
    order = F.xxhash64("doc_id")
    chosen = (
        labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("label"))
        .where("doc_id IS NOT NULL AND label IS NOT NULL")
        .where(fold(F.col("doc_id"), folds) != 0)
        .groupBy("doc_id").agg(F.min("label").alias("label"))
        .orderBy(order, "doc_id").limit(rows)
    )
    sample = (
        docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
        .join(F.broadcast(chosen), "doc_id")  # at most ``rows`` ids
        .withColumn("epoch", F.explode(F.sequence(F.lit(1), F.lit(epochs))))
        .withColumn("turn", F.xxhash64("doc_id", "epoch"))
        .repartition(1)
        .sortWithinPartitions("epoch", "turn", "doc_id", "text")
        .select("label", "text")
    )

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Ftrl((1 << bits) + 1)
        for batch in A.blocks(batches):
            found, counts = features(batch.column("text"), bits)
            ends = np.cumsum(counts)
            for label, end, n in zip(batch.column("label").to_pylist(), ends.tolist(), counts.tolist(), strict=True):
                at, times = np.unique(found[end - n : end], return_counts=True)
                x = np.append(times / max(n, 1), 1.0)
                model.learn(np.append(at, 1 << bits), x, float(label))
        yield pa.RecordBatch.from_arrays([pa.array([model.weights().astype(np.float32).tobytes()], pa.binary())], ["w"])

    (row,) = sample.mapInArrow(learn, "w binary").collect()[:1] or [(None,)]
    return np.frombuffer(row[0], np.float32) if row[0] else np.zeros((1 << bits) + 1, np.float32)


def scores(texts: pa.Array, weights: np.ndarray, bits: int = BITS) -> np.ndarray:
    found, counts = features(texts, bits)
    each = weights[found].sum(1, dtype=np.float64) if len(found) else np.zeros(0)
    sums = np.concatenate(([0.0], np.cumsum(each)))
    ends = np.cumsum(counts)
    z = (sums[ends] - sums[ends - counts]) / np.maximum(counts, 1) + weights[-1]
    return 1 / (1 + np.exp(-z))


def score_quality(
    docs: DataFrame, weights: np.ndarray, text_col: str = "text", output: str = "score", bits: int = BITS
) -> DataFrame:
    """``docs`` with a score from 0 to 1, higher for likelier quality. Null, empty and blank texts
    score the bias alone. Rows are scored one by one, whole; a column named ``output`` is replaced."""
    model = docs.sparkSession.sparkContext.broadcast(weights)
    kept = [c for c in docs.columns if c != output]
    schema = docs.select(*kept).schema.add(output, "double")

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in A.blocks(batches, text_col):
            made = pa.array(scores(batch.column(text_col), model.value, bits), pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.columns, made], [*batch.schema.names, output])

    return docs.select(*kept).mapInArrow(score, schema)
