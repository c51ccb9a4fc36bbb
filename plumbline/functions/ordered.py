"""Ordered work inside groups without putting a whole group in one task.

A plain ``Window.partitionBy(key).orderBy(v)`` sorts each key in a single task,
which fails when one key holds a large share of the rows. The helpers here cut
every group into *slices* of the ordering column. The cut points are quantiles of
the whole table, so any (key, slice) pair holds at most about ``rows / slices``
rows however skewed the keys are. Running sums are taken inside a slice and then
shifted by the totals of the earlier slices of the same key, a table with at most
``slices`` rows per key.

The cut points only steer balance: results are exact for any cut points.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SLICE = "__slice"
MAX_SLICES = 1024
ACCURACY_PER_SLICE = 16  # quantile error of a sixteenth of a slice


def slice_count(df: DataFrame) -> int:
    """As many slices as shuffle partitions: the unit in which Spark spreads work."""
    configured = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(2, min(MAX_SLICES, configured))


def _further(cuts: Column, value: Column, at: Column, step) -> Column:
    """A step of a binary search: a place beyond the last cut point is null there, and the step is not taken."""
    return at + F.when(F.get(cuts, at + step - 1) <= value, step).otherwise(0)


def _position(cuts: Column, value: Column, slices: int) -> Column:
    """Number of cut points <= value, by binary search: a comparison per bit instead of one per cut point."""
    steps = F.array(*[F.lit(1 << k) for k in reversed(range(slices.bit_length()))])
    return F.aggregate(steps, F.lit(0), lambda at, step: _further(cuts, value, at, step))


def _positioned(df: DataFrame, cuts: Column, value: Column, slices: int, name: str) -> DataFrame:
    """``_position`` as column ``name``, a projection per step: Spark compiles these, but not the lambda of one expression."""
    out = df.withColumn(name, F.lit(0))
    for k in reversed(range(slices.bit_length())):
        out = out.withColumn(name, _further(cuts, value, F.col(name), F.lit(1 << k)))
    return out


def with_slices(
    df: DataFrame,
    order: str,
    tiebreak: str | None = None,
    slices: int | None = None,
    touch: Sequence[str] = (),
    sample_from: DataFrame | None = None,
) -> DataFrame:
    """Add ``__slice``, ordered like (order, tiebreak).

    A value heavy enough to be two cut points gets slices of its own with a
    ``tiebreak`` (a string spread evenly over its first two characters, such as a
    hash id): they are divided by that prefix, so a single hot timestamp
    does not end up in one task either. A value that is one cut point holds less than two
    slices' rows and stays whole, or every cut point would leave hundreds of tiny slices.

    ``touch`` names further columns that the caller reads from ``df``. Reading them
    here too keeps ``df`` the same subplan in both places, so Spark reuses its shuffle
    for the quantiles instead of computing ``df`` twice. ``sample_from`` is a cheaper
    table with the same kind of values in its only column: the quantiles then cost one
    map-side pass over that column.
    """
    n = slices or slice_count(df)
    value = F.col(order)
    if sample_from is not None:
        source, seen = sample_from, F.col(sample_from.columns[0])
    else:
        source, seen = df, F.when(F.hash(*touch) >= F.lit(-(2**31)), value) if touch else value
    quantiles = source.agg(
        F.percentile_approx(seen, [i / n for i in range(1, n)], n * ACCURACY_PER_SLICE)
    ).scalar()
    cuts = F.col("__cuts")
    # an empty or tiny input has no cut points: everything is slice 0
    placed = _positioned(df.withColumn("__cuts", quantiles), cuts, value, n, "__at")
    where = F.coalesce("__at", F.lit(0))
    if tiebreak is None:
        return placed.withColumn(SLICE, where).drop("__cuts", "__at")
    on_cut = F.coalesce((F.get(cuts, where - 1) == value) & (F.get(cuts, where - 2) == value), F.lit(False))
    return placed.withColumn(
        SLICE,
        F.struct(
            where.alias("part"),
            (~on_cut).alias("between"),
            F.when(on_cut, F.substring(tiebreak, 1, 2)).otherwise("").alias("tie"),
        ),
    ).drop("__cuts", "__at")


def running_totals(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    sums: dict[str, str],
    tiebreak: str | None = None,
    with_next: bool = False,
    slices: int | None = None,
    sample_from: DataFrame | None = None,
) -> DataFrame:
    """Inclusive running sums ``cum_<name>`` and group sums ``total_<name>``.

    ``sums`` maps a name to the column to add up. Rows of one key must be unique in
    (order, tiebreak). ``with_next`` also adds ``next_value``: the next larger
    ``order`` value of the key, null on the last row.
    """
    keys = list(keys)
    sliced = with_slices(df, order, tiebreak, slices, list(sums.values()), sample_from)
    ordering = [order] + ([tiebreak] if tiebreak else [])
    inside = Window.partitionBy(*keys, SLICE).orderBy(*ordering)
    upto = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)

    per_slice = sliced.groupBy(*keys, SLICE).agg(
        *[F.sum(c).alias(f"__sum_{n}") for n, c in sums.items()],
        F.min(order).alias("__first"),
    )
    # at most `slices` (times tie prefixes) rows per key from here on
    across = Window.partitionBy(*keys).orderBy(SLICE)
    before = across.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*keys)
    shifts = per_slice.select(
        *keys,
        SLICE,
        *[F.coalesce(F.sum(f"__sum_{n}").over(before), F.lit(0)).alias(f"__off_{n}") for n in sums],
        *[F.sum(f"__sum_{n}").over(whole).alias(f"total_{n}") for n in sums],
        *([F.lead("__first").over(across).alias("__next_first")] if with_next else []),
    )
    local = sliced.select(
        "*",
        *[F.sum(c).over(upto).alias(f"__cum_{n}") for n, c in sums.items()],
        *([F.lead(order).over(inside).alias("__next_inside")] if with_next else []),
    )
    out = local.join(shifts, [*keys, SLICE])
    return out.select(
        *df.columns,
        *[(F.col(f"__cum_{n}") + F.col(f"__off_{n}")).alias(f"cum_{n}") for n in sums],
        *[F.col(f"total_{n}") for n in sums],
        *([F.coalesce("__next_inside", "__next_first").alias("next_value")] if with_next else []),
    )


def row_numbers(
    df: DataFrame, keys: Sequence[str], order: str, tiebreak: str, name: str = "rn", sample_from: DataFrame | None = None
) -> DataFrame:
    """1-based position of each row in its key by (order, tiebreak), and ``total_rows``."""
    counted = running_totals(
        df.withColumn("__one", F.lit(1)), keys, order, {"rows": "__one"}, tiebreak, sample_from=sample_from or df.select(order)
    )
    return counted.withColumnRenamed("cum_rows", name).drop("__one")


def row_frames(
    df: DataFrame,
    keys: Sequence[str],
    rn: str,
    before: int,
    after: int,
    frames: Callable[[Window], dict[str, Column]],
    block: int = 65_536,
) -> DataFrame:
    """Window expressions whose frame reaches ``before`` rows back and ``after`` ahead.

    Rows are grouped in blocks of consecutive row numbers. The few rows next to a
    block border are copied to the neighbour block, so every frame is complete
    inside its block and a hot key spreads over many tasks. ``frames`` gets the
    ordered window and returns the columns to add.
    """
    keys = list(keys)
    pos = (F.col(rn) - 1) % block
    home = F.floor((F.col(rn) - 1) / block)
    copies = F.filter(
        F.array(
            home,
            F.when(pos >= block - before, home + 1),
            F.when((pos < after) & (home > 0), home - 1),
        ),
        lambda b: b.isNotNull(),
    )
    placed = df.withColumn("__home", home).withColumn("__block", F.explode(copies))
    added = frames(Window.partitionBy(*keys, "__block").orderBy(rn))
    return (
        placed.select("*", *[c.alias(n) for n, c in added.items()])
        .where(F.col("__block") == F.col("__home"))
        .drop("__block", "__home")
    )
