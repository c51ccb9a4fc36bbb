"""Which interval covers a point, without comparing all pairs.

An interval of integers is split into at most two aligned power-of-two blocks per level
(a segment-tree cover); a point lies in exactly one block per level. An equi-join on
(level, block) therefore finds every covering interval, and when only the best interval
per point is wanted, the blocks are reduced to one row each before the join. Work grows
linearly with intervals and points however many of them overlap.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def cover_blocks(lo: Column, hi: Column, levels: int) -> Column:
    """Array of (level, block) structs that cover lo..hi inclusive exactly once."""

    def at(level: Column) -> Column:
        size = F.pow(F.lit(2), level).cast("long")
        a = F.floor((lo + size - 1) / size).cast("long")
        b = F.floor((hi + 1) / size).cast("long")
        block = lambda k: F.struct(level.alias("level"), k.alias("block"))
        open_ = a < b
        left = F.when(open_ & (F.pmod(a, F.lit(2)) == 1), block(a))
        right = F.when(open_ & (F.pmod(b, F.lit(2)) == 1), block(b - 1))
        return F.array_compact(F.array(left, right))

    inner = F.flatten(F.transform(F.sequence(F.lit(0), F.lit(levels - 2)), at))
    # the top level keeps whatever is still open
    top = F.lit(levels - 1)
    size = F.lit(2 ** (levels - 1)).cast("long")
    a, b = F.floor((lo + size - 1) / size).cast("long"), F.floor((hi + 1) / size).cast("long")
    rest = F.when(
        a < b, F.transform(F.sequence(a, b - 1), lambda k: F.struct(top.alias("level"), k.alias("block")))
    ).otherwise(F.expr("cast(array() as array<struct<level:int,block:bigint>>)"))
    return F.concat(inner, rest)


def point_blocks(t: Column, levels: int) -> Column:
    """The block of every level that contains ``t``."""
    return F.transform(
        F.sequence(F.lit(0), F.lit(levels - 1)),
        lambda level: F.struct(level.alias("level"), F.floor(t / F.pow(F.lit(2), level)).cast("long").alias("block")),
    )
