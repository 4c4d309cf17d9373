"""A bitmap over 64-bit keys: a key that is in the set always shows; others show seldom.

It has some eight bits a key, and at most 2 ** MOST_BITS; beyond that more and more keys show. It only saves work: what
shows is always joined exactly afterwards.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LEAST_BITS, MOST_BITS = 18, 27  # 32 KB to 16 MB


def _position(keys: np.ndarray, bits: int) -> np.ndarray:
    return (keys.astype(np.int64).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits)


def build(keys: DataFrame, column: str) -> np.ndarray:
    """The bitmap of a column of longs, put together from 4 KB pieces that are aggregated on both sides of a shuffle."""
    size = min(max((8 * keys.count()).bit_length(), LEAST_BITS), MOST_BITS)

    def positions(batches):
        for batch in batches:
            values = np.unique(_position(batch.column(0).drop_null().to_numpy(zero_copy_only=False), size))
            yield pa.RecordBatch.from_arrays([pa.array(values.astype(np.int64) + 1)], ["bit"])

    bit = keys.select(F.col(column).cast("long")).mapInArrow(positions, "bit long")
    pieces = bit.groupBy(F.bitmap_bucket_number("bit").alias("piece")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("bit")).alias("bits"))
    out = np.zeros(1 << (size - 3), np.uint8)
    for piece, bits in pieces.collect():  # at most 2 ** (MOST_BITS - 15) rows of 4 KB
        out[(piece - 1) * 4096 : piece * 4096] = np.frombuffer(bytes(bits), np.uint8)
    return out


def shows(bitmap: np.ndarray, keys: np.ndarray) -> np.ndarray:
    at = _position(keys, len(bitmap).bit_length() + 2)
    return (bitmap[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & np.uint8(1) == 1
