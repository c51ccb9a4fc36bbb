"""Permutation tests of two-sample distances with all repetitions side by side.

A pair's rows are shuffled once, to (pair, value slice). A task relabels the rows of its slice for every repetition by
a counter-based generator keyed by the row's id, a matrix of rows x repetitions that exists in blocks only, so what is
shuffled does not depend on the number of repetitions:

1. each slice returns one row with its counts of first-side labels per repetition;
2. running sums over a pair's slices give the counts before each slice, and the totals;
3. each slice returns its part of the statistic per repetition; a pair's parts are added up.

A value so common that it is a cut point has slices of its own, divided by a hash of the id. Rows of equal value add nothing
between them, so they need not be merged.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ordered import SLICE, slice_count, with_slices
from ..functions.storage import materialise
from .ecdf import PAIR

#: Labels (rows x repetitions) worked on at a time: few enough to stay in a core's cache.
BLOCK_LABELS = 1 << 16
KINDS = ("wasserstein", "energy")
_PAIR_SCHEMA = "repo_id string, metric_id string, window_a int, window_b int"


def row_key(seed: int, row_id: Column) -> Column:
    """Eight bytes of a row's own from the MD5 of seed and id."""
    return F.unhex(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), row_id)), 1, 16))


def labels(keys: np.ndarray, reps: int, bound: float) -> np.ndarray:
    """(rows, repetitions): whether the upper 32 bits of a 64-bit counter-based generator at key + repetition are below ``bound``."""
    with np.errstate(over="ignore"):
        z = keys[:, None] + np.arange(1, reps + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        t = z >> np.uint64(30)
        z ^= t
        z *= np.uint64(0xBF58476D1CE4E5B9)
        z ^= np.right_shift(z, np.uint64(27), out=t)
        z *= np.uint64(0x94D049BB133111EB)
        z ^= np.right_shift(z, np.uint64(31), out=t)
    limit = math.ceil(bound) << 32
    return z < np.uint64(limit) if limit < 1 << 64 else np.ones(z.shape, bool)


def blocks(n: int, reps: int) -> range:
    """Starts of blocks of rows, and their size as the step."""
    return range(0, n, max(1, BLOCK_LABELS // reps))


def _rows(table: pa.Table) -> tuple[np.ndarray, np.ndarray, float]:
    """Values in order with their keys, and the bound that a first-side label stays below."""
    value = table.column("value").to_numpy()
    key = np.frombuffer(b"".join(table.column("key").to_pylist()), ">u8").astype(np.uint64)
    order = np.lexsort((key, value))
    return value[order], key[order], table.column("share")[0].as_py() * 2.0**32


def _pair_of(table: pa.Table) -> dict:
    return {c: table.column(c).slice(0, 1) for c in PAIR}


def _slice_counts(reps: int):
    def count(table: pa.Table) -> pa.Table:
        value, key, bound = _rows(table)
        first = np.zeros(reps, np.int64)
        every = blocks(len(key), reps)
        for at in every:
            first += labels(key[at : at + every.step], reps, bound).sum(axis=0)
        own = {"slice": [table.column("slice")[0].as_py()], "n": [len(value)], "first_value": [value[0]], "c1": [first.tobytes()]}
        return pa.table(_pair_of(table) | own)

    return count


def _before(table: pa.Table) -> pa.Table:
    """Counts before each slice of a pair, its totals and the first value of the next slice: one row per slice."""
    table = table.sort_by("slice")
    n = table.column("n").to_numpy()
    c1 = np.stack([np.frombuffer(x, np.int64) for x in table.column("c1").to_pylist()])
    before = np.cumsum(c1, axis=0) - c1
    values = table.column("first_value").to_numpy()
    return table.select([*PAIR, "slice"]).append_column("n_before", pa.array(np.cumsum(n) - n)).append_column(
        "c1_before", pa.array([x.tobytes() for x in before], pa.binary())
    ).append_column("n_total", pa.array(np.full(len(n), n.sum()))).append_column(
        "c1_total", pa.array([c1.sum(axis=0).tobytes()] * len(n), pa.binary())
    ).append_column("next_value", pa.array(np.r_[values[1:], np.nan]))


def _slice_parts(reps: int, kind: str):
    def part(rows: pa.Table, state: pa.Table) -> pa.Table:
        value, key, bound = _rows(rows)
        get = lambda name: state.column(name)[0].as_py()
        total, n1 = get("n_total"), np.frombuffer(get("c1_total"), np.int64).astype(np.float64)
        n2 = total - n1
        after = get("next_value")
        width = np.diff(np.r_[value, value[-1] if np.isnan(after) else after])
        first, seen = np.frombuffer(get("c1_before"), np.int64).copy(), get("n_before")
        out = np.zeros(reps)
        with np.errstate(divide="ignore", invalid="ignore"):
            every = blocks(len(key), reps)
            for at in every:
                u1 = np.cumsum(labels(key[at : at + every.step], reps, bound), axis=0)
                u1 += first
                u2 = (seen + np.arange(1, len(u1) + 1))[:, None] - u1
                gap = u1 / n1
                gap -= u2 / n2
                np.abs(gap, out=gap) if kind == "wasserstein" else np.multiply(gap, gap, out=gap)
                out += (width[at : at + every.step] if kind == "wasserstein" else 2.0 * width[at : at + every.step]) @ gap
                first, seen = u1[-1], seen + len(u1)
        out[(n1 == 0) | (n2 == 0)] = np.nan  # a repetition without two sides
        return pa.table(_pair_of(rows) | {"part": [out.tobytes()]})

    return part


def _added(table: pa.Table) -> pa.Table:
    total = np.sum([np.frombuffer(x) for x in table.column("part").to_pylist()], axis=0)
    stats = pa.array([total[~np.isnan(total)]], pa.list_(pa.float64()))
    return pa.table(_pair_of(table) | {"stats": stats})


def permuted_statistics(windowed: DataFrame, pairs: DataFrame, kind: str, reps: int, seed: int) -> DataFrame:
    """(pair, stats): the statistic of every repetition that has two sides.

    Each row of a pair goes to the first side with probability n1 / (n1 + n2), whatever the partitioning.
    """
    rows = windowed.where("window_index is not null").select("repo_id", "metric_id", "window_index", "observation_id", "value")
    keyed = pairs.select(*PAIR, (F.col("n1") / (F.col("n1") + F.col("n2"))).alias("share"))
    own = ["repo_id", "metric_id", F.col("window_a").cast("int").alias("window_a"), F.col("window_b").cast("int").alias("window_b")]
    sides = [
        rows.join(keyed.withColumn("window_index", F.col(w)), ["repo_id", "metric_id", "window_index"])
        .select(*own, "share", "value", "observation_id") for w in ("window_a", "window_b")
    ]
    spread = min(100, slice_count(rows))  # parts of a value that is a cut point
    both = sides[0].unionByName(sides[1]).withColumn("tie", F.lpad((F.crc32("observation_id") % spread).cast("string"), 2, "0"))
    cut = with_slices(both, "value", "tie", sample_from=rows.select("value"))
    at = F.col(SLICE)
    name = F.concat(F.lpad(at["part"].cast("string"), 6, "0"), at["between"].cast("int").cast("string"), at["tie"])
    placed = materialise(cut.select(*PAIR, "share", "value", row_key(seed, F.col("observation_id")).alias("key"), name.alias("slice")), "permuted-rows")
    groups = placed.groupBy(*PAIR, "slice")
    counts = groups.applyInArrow(_slice_counts(reps), f"{_PAIR_SCHEMA}, slice string, n long, first_value double, c1 binary")
    state = counts.groupBy(*PAIR).applyInArrow(_before, f"{_PAIR_SCHEMA}, slice string, n_before long, c1_before binary, n_total long, c1_total binary, next_value double")
    parts = groups.cogroup(state.groupBy(*PAIR, "slice")).applyInArrow(_slice_parts(reps, kind), f"{_PAIR_SCHEMA}, part binary")
    return parts.groupBy(*PAIR).applyInArrow(_added, f"{_PAIR_SCHEMA}, stats array<double>")


def permutation_test(windowed: DataFrame, pairs: DataFrame, observed: DataFrame, kind: str, reps: int, seed: int) -> DataFrame:
    """``observed`` (pair, statistic) with ``p_value``: the share of repetitions that reach the observed statistic."""
    drawn = permuted_statistics(windowed, pairs, kind, reps, seed)
    at_least = F.size(F.filter("stats", lambda s: s >= F.col(kind) - 1e-9))
    with_p = observed.join(drawn, PAIR, "left").withColumn("p_value", F.try_divide(at_least, F.size("stats")))
    return with_p.drop("stats")
