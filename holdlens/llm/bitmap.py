"""Bitmaps of fixed size that tell which hashes can't be in a set, whatever its size."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bits of a part, as ``bitmap_construct_agg`` makes them.
_PART = 32768


def broadcast_bitmap(hashes: DataFrame, column: str, bits: int):
    """A broadcast bitmap of ``bits`` bits, a power of two, with the low bits of the 64-bit hashes in ``column`` set.

    At most ``bits / 8`` bytes come to the driver, part by part.
    """
    low = F.col(column).bitwiseAND(bits - 1)
    parts = hashes.select((low / _PART).cast("int").alias("part"), (low % _PART).alias("bit")).groupBy("part").agg(F.bitmap_construct_agg("bit").alias("bits"))
    out = np.zeros(max(bits, _PART) // 8, np.uint8)
    for r in parts.toLocalIterator():
        out[r.part * _PART // 8 : (r.part + 1) * _PART // 8] = np.frombuffer(bytes(r.bits), np.uint8)
    return hashes.sparkSession.sparkContext.broadcast(out.tobytes())


def may_be_in(bitmap: bytes, hashes: np.ndarray) -> np.ndarray:
    """Which of the 64-bit ``hashes`` may be in the set; those that are in it always are."""
    bits = np.frombuffer(bitmap, np.uint8)
    at = hashes.view(np.int64) & (8 * len(bits) - 1)
    return ((bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1).view(bool)
