"""Permutations of the kernel discrepancy with all repetitions side by side.

The kernel is a mean of cosines, so a side's part in a repetition is a sum of the cosines and sines of its rows. A task
turns a block of rows into a matrix of labels (rows x repetitions) and one of waves (rows x frequencies), and keeps
only their product for each pair: rows are dealt out once and none is copied for a repetition; what is added up over tasks
does not grow with the rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.ordered import slice_count
from ..functions.storage import materialise
from .ecdf import PAIR

#: Rows worked on at a time, and pairs whose sums a task holds before it passes them on.
BLOCK, HELD = 4096, 256
_PARTS = "pair long, n long, first binary, sums binary, total binary"


def _bound(share):
    """Hex digits that the first eight of a label's MD5 stay below, as text, for labels below ``share`` of 2**32."""
    limit = F.ceil(share * float(1 << 32))
    return F.when(limit >= 1 << 32, "g").otherwise(F.lpad(F.lower(F.hex(limit)), 8, "0"))


def _sums(frequencies: np.ndarray, reps: int):
    """Partial sums of each pair: rows, first-side rows and waves per repetition, and waves of all rows."""

    def passed(held: dict) -> pa.RecordBatch:
        rows = [(k, n, first.tobytes(), sums.tobytes(), total.tobytes()) for k, (n, first, sums, total) in held.items()]
        columns = zip(*rows) if rows else ([],) * 5
        types = (pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], ["pair", "n", "first", "sums", "total"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}
        for whole in batches:
            for at in range(0, whole.num_rows, BLOCK):
                batch = whole.slice(at, BLOCK)
                pair = batch.column("pair").to_numpy()
                label = batch.column("labels").flatten().to_numpy(zero_copy_only=False).reshape(len(pair), reps).astype(np.float64)
                x = batch.column("x")
                angle = x.fill_null(0.0).to_numpy()[:, None] * frequencies
                waves = np.concatenate([np.cos(angle), np.sin(angle)], axis=1)
                waves[x.is_null().to_numpy(zero_copy_only=False)] = 0.0
                for k in np.unique(pair).tolist():
                    own = pair == k
                    n, first, sums, total = held.get(k) or (0, np.zeros(reps), np.zeros((reps, waves.shape[1])), np.zeros(waves.shape[1]))
                    mine, wave = label[own], waves[own]
                    held[k] = (n + len(mine), first + mine.sum(axis=0), sums + mine.T @ wave, total + wave.sum(axis=0))
                if len(held) > HELD:
                    yield passed(held)
                    held = {}
        yield passed(held)

    return run


def _discrepancies(frequencies: int, reps: int):
    """Discrepancy of every repetition that has two sides, from the parts of a pair."""

    def finish(table: pa.Table) -> pa.Table:
        add = lambda c, shape: sum(np.frombuffer(x).reshape(shape) for x in table.column(c).to_pylist())
        n = float(sum(table.column("n").to_pylist()))
        n1, s1, total = add("first", (reps,)), add("sums", (reps, 2 * frequencies)), add("total", (2 * frequencies,))
        n2, s2 = n - n1, total - s1
        with np.errstate(divide="ignore", invalid="ignore"):
            a, b = s1 / n1[:, None], s2 / n2[:, None]
            product = lambda u, v: (u * v).sum(axis=1) / frequencies
            xx, yy = (product(a, a) * n1 - 1) / (n1 - 1), (product(b, b) * n2 - 1) / (n2 - 1)
            value = np.maximum(0.0, xx + yy - 2 * product(a, b))
        value = np.where((n1 > 1) & (n2 > 1) & total.any(), value, 0.0)
        return pa.table({"pair": table.column("pair").slice(0, 1), "stats": pa.array([value[(n1 > 0) & (n2 > 0)]], pa.list_(pa.float64()))})

    return finish


def permuted_discrepancies(windowed: DataFrame, pairs: DataFrame, scale: DataFrame, frequencies: list[float], reps: int, seed: int) -> DataFrame:
    """(pair, stats): the discrepancy of every repetition that has two sides.

    In a repetition a row of a pair goes to the first side with probability n1 / (n1 + n2), by the MD5 of seed, repetition
    and id: the same in any SQL engine. ``scale`` has the bandwidth ``h`` of each pair; without a positive one it is 0.
    """
    share = F.col("n1") / (F.col("n1") + F.col("n2"))
    keyed = pairs.join(scale, PAIR, "left").select(*PAIR, _bound(share).alias("bound"), F.when(F.col("h") > 0, F.col("h")).alias("h"))
    keyed = materialise(keyed.withColumn("pair", F.monotonically_increasing_id()), "numbered-pairs")
    rows = windowed.where("window_index is not null").select("repo_id", "metric_id", "window_index", "observation_id", "value")
    text = lambda rep: F.concat_ws("|", F.lit(str(seed)), rep.cast("string"), "observation_id")
    label = F.transform(F.sequence(F.lit(1), F.lit(reps)), lambda rep: F.md5(text(rep)) < F.col("bound"))
    sides = [
        rows.join(keyed.withColumn("window_index", F.col(w)), ["repo_id", "metric_id", "window_index"]).select(
            "pair", "bound", "observation_id", (F.col("value") / F.col("h")).alias("x")
        ) for w in ("window_a", "window_b")
    ]
    # once dealt out: a few files would otherwise be a few tasks for all labels
    dealt = sides[0].unionByName(sides[1]).repartition(slice_count(rows), "pair", "observation_id", "x")
    parts = dealt.select("pair", "x", label.alias("labels")).mapInArrow(_sums(np.array(frequencies), reps), _PARTS)
    drawn = parts.groupBy("pair").applyInArrow(_discrepancies(len(frequencies), reps), "pair long, stats array<double>")
    return drawn.join(keyed.select("pair", *PAIR), "pair").drop("pair")
