"""A Bloom filter over a long column, of bounded size, to broadcast."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .texts import mix

HASHES = 4
BITS_PER_KEY = 16
#: 32 MB; beyond it the filter passes more keys in vain but never loses one.
MAX_BITS = 1 << 28


def _places(keys: np.ndarray, bits: int) -> np.ndarray:
    h1, h2 = mix(keys), mix(keys + np.uint64(1)) | np.uint64(1)
    return np.stack([(h1 + np.uint64(i) * h2) & np.uint64(bits - 1) for i in range(HASHES)])


def build(df: DataFrame, column: str, keys: int, per_key: int = BITS_PER_KEY, whole: bool = False) -> np.ndarray:
    """The filter of ``column`` (long) as 64-bit words; ``keys`` sets its size, ``per_key`` bits
    each.  With ``whole`` a task sends its words once, not for each batch, and holds a filter."""
    bits = min(MAX_BITS, 1 << max(12, math.ceil(math.log2(max(1, keys) * per_key))))

    def run_whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.zeros(bits >> 6, np.uint64)
        for batch in batches:
            for at in _places(batch.column("k").to_numpy().view(np.uint64), bits):
                np.bitwise_or.at(own, at >> np.uint64(6), np.uint64(1) << (at & np.uint64(63)))
        for i in range(0, len(own), 1 << 18):
            word = np.flatnonzero(own[i:i + (1 << 18)]) + i
            yield pa.RecordBatch.from_arrays([pa.array(word.astype(np.int64)), pa.array(own[word].view(np.int64))], ["i", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = _places(batch.column("k").to_numpy().view(np.uint64), bits).ravel()
            word, inverse = np.unique(at >> np.uint64(6), return_inverse=True)
            value = np.zeros(len(word), np.uint64)
            np.bitwise_or.at(value, inverse, np.uint64(1) << (at & np.uint64(63)))
            yield pa.RecordBatch.from_arrays([pa.array(word.astype(np.int64)), pa.array(value.view(np.int64))], ["i", "v"])

    found = (df.select(F.col(column).alias("k")).filter("k IS NOT NULL").mapInArrow(run_whole if whole else run, "i long, v long")
             .groupBy("i").agg(F.bit_or("v").alias("v"))).toArrow()
    out = np.zeros(bits >> 6, np.uint64)
    out[found.column("i").to_numpy()] = found.column("v").to_numpy().view(np.uint64)
    return out


def may_have(words: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Whether the filter may have each key (uint64)."""
    at = _places(keys, len(words) << 6)
    return np.all((words[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1), axis=0).astype(bool)
