"""Bloom filters of fixed size over 64-bit hashes, made by Spark and asked in the tasks."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, functions as F

BITS = 24  # 2 MB whatever goes in; more keys let more pass, and what passes by chance finds no partner


def build(hashes: DataFrame, column: str, bits: int = BITS) -> np.ndarray:
    """The filter of one long column, as 32-bit words: two places a hash, merged by word."""
    mask = F.lit((1 << bits) - 1)
    places = F.array(F.col(column).bitwiseAND(mask), F.shiftrightunsigned(column, 64 - bits).bitwiseAND(mask))
    bit = F.expr("shiftleft(1L, cast(place & 31 AS int))")
    words = (
        hashes.select(F.explode(places).alias("place"))
        .groupBy(F.shiftright("place", 5).alias("word"))
        .agg(F.bit_or(bit).alias("bits"))
    )
    out = np.zeros(1 << (bits - 5), np.uint32)
    found = words.toPandas()  # at most 2 ** (bits - 5) rows
    out[found["word"].to_numpy(np.int64)] = found["bits"].to_numpy(np.int64).astype(np.uint32)
    return out


def passing(words: np.ndarray, hashes: np.ndarray, bits: int = BITS) -> np.ndarray:
    """The places of the hashes that may be in the filter."""
    mask = np.uint64((1 << bits) - 1)

    def held(places: np.ndarray) -> np.ndarray:
        return (words[places >> np.uint64(5)] >> (places & np.uint64(31)).astype(np.uint32)) & 1 != 0

    found = np.flatnonzero(held(hashes & mask))
    return found[held(hashes[found] >> np.uint64(64 - bits))]
