"""A Bloom filter of fixed size, built by Spark and used inside tasks to keep shuffles small.

It only passes more rows on when it fills up; an exact join or filter always follows it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BITS = 1 << 23  # 1 MB; a power of two
PROBES = 4


class Bloom:
    def __init__(self, words: np.ndarray):
        self.words = words  # uint64

    def holds(self, hashes: np.ndarray) -> np.ndarray:
        """For each 64-bit hash, whether it may have been put in."""
        found = np.ones(len(hashes), dtype=bool)
        for position in _positions(hashes, 64 * len(self.words)):
            bit = self.words[position >> np.uint64(6)] >> (position & np.uint64(63))
            found &= (bit & np.uint64(1)).astype(bool)
        return found


def _positions(hashes: np.ndarray, bits: int) -> list[np.ndarray]:
    step = (hashes >> np.uint64(32)) | np.uint64(1)
    return [(hashes + np.uint64(i) * step) & np.uint64(bits - 1) for i in range(PROBES)]


def build_bloom(hashes: DataFrame, bits: int = BITS) -> Bloom:
    """Of a table with one long column; each task sends at most one row per filter word."""

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = np.zeros(bits // 64, dtype=np.uint64)
        for batch in batches:
            values = np.asarray(batch.column(0).drop_null()).astype(np.int64).view(np.uint64)
            for position in _positions(values, bits):
                np.bitwise_or.at(words, (position >> np.uint64(6)).astype(np.int64),
                                 np.uint64(1) << (position & np.uint64(63)))
        used = np.flatnonzero(words)
        yield pa.RecordBatch.from_arrays(
            [pa.array(used.astype(np.int64)), pa.array(words[used].view(np.int64))], names=["at", "bits"])

    parts = hashes.mapInArrow(fill, "at long, bits long")
    words = np.zeros(bits // 64, dtype=np.uint64)
    merged = parts.groupBy("at").agg(F.bit_or("bits").alias("bits")).toArrow()
    words[np.asarray(merged["at"])] = np.asarray(merged["bits"]).view(np.uint64)
    return Bloom(words)
