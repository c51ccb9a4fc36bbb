"""Bitmaps of fixed size over hash values: a sieve that can be sent to every task whatever the input."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: 2**24 bits, 2 MB.
BITS = 24


def bitmap_of(values: DataFrame, bits: int = BITS) -> np.ndarray:
    """The bitmap of the long column ``value``; at most 2**(bits - 6) rows come to the driver."""
    top = F.shiftrightunsigned("value", 64 - bits)
    words = values.select(F.shiftright(top, 6).alias("word"), F.expr(f"shiftleft(1L, int(shiftrightunsigned(value, {64 - bits}) & 63L))").alias("bit"))
    out = np.zeros(1 << (bits - 6), np.int64)
    for word, value in words.groupBy("word").agg(F.bit_or("bit")).collect():
        out[word] = value
    return out.view(np.uint64)


def in_bitmap(bitmap: np.ndarray, hashes: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Whether each unsigned hash may be among the values; never false for one that is."""
    top = hashes >> np.uint64(64 - bits)
    return (bitmap[top >> np.uint64(6)] >> (top & np.uint64(63)) & np.uint64(1)).astype(bool)
