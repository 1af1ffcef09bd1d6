"""A Bloom filter of bounded size over 64-bit hashes, filled in chunks by the executors.

It only spares work: a false positive lets a row through that an exact join then drops.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkatlas.llm import words as W

MOST_BITS = 1 << 28
BITS, PROBES, CHUNKS = 12, 5, 32


class Bloom:
    def __init__(self, bits: np.ndarray):
        self.bits = bits  # CHUNKS rows of bytes

    def has(self, h: np.ndarray) -> np.ndarray:
        out = np.ones(len(h), bool)
        chunk = (h & W.U(CHUNKS - 1)).astype(np.int64)
        left = np.arange(len(h))
        for j in range(PROBES):
            p = place(h[left], j, self.bits.shape[1] * 8)
            hit = (self.bits[chunk[left], p >> 3] >> (p & 7).astype(np.uint8)) & 1 == 1
            out[left[~hit]] = False
            left = left[hit]
        return out


def place(h: np.ndarray, j: int, size: int) -> np.ndarray:
    x = W.mix(h)
    return (((x & W.U(0xFFFFFFFF)) + W.U(j) * ((x >> W.U(32)) | W.U(1))) % W.U(size)).astype(np.int64)


def bloom(table: DataFrame, column: str) -> Bloom:
    """Of a column of longs of a written table; MOST_BITS bits at most, whatever the number of rows."""
    n = table.count()
    size = max(1, math.ceil(min(MOST_BITS, n * BITS) / CHUNKS / 8))

    def run(batches):
        got: dict[int, np.ndarray] = {}
        for batch in batches:
            h, chunk = batch.column(0).to_numpy().view(W.U), batch.column(1).to_numpy()
            for k in np.unique(chunk):
                bits = got.setdefault(int(k), np.zeros(size, np.uint8))
                for j in range(PROBES):
                    p = place(h[chunk == k], j, size * 8)
                    np.bitwise_or.at(bits, p >> 3, np.left_shift(1, p & 7).astype(np.uint8))
        for k, bits in got.items():
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([bits.tobytes()], pa.binary())], ["k", "bits"])

    h = F.col(column)
    rows = table.select(h.alias("h"), h.bitwiseAND(F.lit(CHUNKS - 1)).cast("int").alias("k")).repartition(CHUNKS, "k").mapInArrow(run, "k int, bits binary").collect()
    bits = np.zeros((CHUNKS, size), np.uint8)
    for r in rows:
        bits[r["k"]] = np.frombuffer(r["bits"], np.uint8)
    return Bloom(bits)
