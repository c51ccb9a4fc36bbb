"""Hard negatives by threshold joins in the manner of L2AP: bounds by remaining norms, thresholds lowered until windows fill.

A search asks, for every anchor vector and each of its windows lo..hi of scores, for the best k rows of the same or of another label.
The rows stay where they are: a task takes its rows in blocks and streams the anchors past them in blocks from a
table in the shared folder, so neither side is ever held whole. For a block of rows and one of anchors

* the dimensions are ordered by energy; a row's suffix is left out of the inverted index from the dimension on where
  its norm times the largest suffix norm of the anchors stays below the lowest threshold, so short rows have no entry at all;
* scores are accumulated over the postings, a few dimensions at a time; rows that no anchor can lift over its
  threshold with the norms that remain are dropped in between;
* the pairs left are completed over the dimensions outside the index, exactly, in whole numbers.

Thresholds start at scores that a bounded sample of rows (``SAMPLE``) suggests for three times the rows wanted, and go
down by ranks of that sample until a window holds k rows or reaches its lower end. The sample only decides how many
rounds and rows it takes; every row is searched and the result is exact.

Edge cases: rows whose id, label or vector is null, or with null or non-finite components, take no part; shorter vectors
count as zero where they end; "other" means another id; rows repeated with equal id are rows of their own, repeated
anchors give their rows once; ties go to the smaller id; empty tables give empty results. Scores must fit in 53 bits, else
ValueError: within them double precision is exact.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.dataset as ds
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.storage import materialise, scratch_path
from .files import filesystem

SAMPLE = 4096
ROWS, ANCHORS = 4096, 512
#: Dimensions accumulated between two prunings.
CHUNK = 16
SLACK = 1e-9
NONE = -np.inf


def prepare(rows: DataFrame, label: Column, scale: int = 256) -> DataFrame:
    """(vec_id, label, v): rows that take part, components as floor(scale * x)."""
    x = F.col("embedding")
    finite = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    good = rows.where("vec_id is not null and label is not null and embedding is not null").where(finite)
    whole = F.transform(x, lambda c: F.floor(c.cast("double") * scale).cast("long"))
    return good.select(F.col("vec_id").cast("long").alias("vec_id"), label.cast("long").alias("label"), whole.alias("v"))


def matrix(column: pa.ChunkedArray | pa.Array, width: int) -> np.ndarray:
    """Rows of a list column, zero where they end early."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    size = np.diff(column.offsets.to_numpy())
    out = np.zeros((len(column), width))
    at = np.repeat(np.arange(len(column)), size)
    out[at, np.arange(len(at)) - np.repeat(np.cumsum(size) - size, size)] = column.flatten().to_numpy()
    return out


def suffix_norms(x: np.ndarray) -> np.ndarray:
    """(rows, width + 1): norm of the components from each dimension on."""
    squares = np.square(x)
    return np.sqrt(np.concatenate([np.cumsum(squares[:, ::-1], axis=1)[:, ::-1], np.zeros((len(x), 1))], axis=1))


def candidates(q: np.ndarray, lowest: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, row, score) of all pairs whose score reaches the anchor's ``lowest``, and no others."""
    width = x.shape[1]
    order = np.argsort(-np.square(x).sum(axis=0), kind="stable")
    q, x = q[:, order], x[:, order]
    q_rest, x_rest = suffix_norms(q), suffix_norms(x)
    slack = 1e-6 + SLACK * q_rest[:, 0].max(initial=0) * x_rest[:, 0].max(initial=0)
    # the index ends where the rest of a row cannot reach the lowest threshold; it is cut at whole chunks
    cuts = np.r_[np.arange(0, width, CHUNK), width]
    reach = x_rest[:, cuts] * q_rest[:, cuts].max(axis=0, initial=0) + slack >= lowest.min(initial=np.inf)
    indexed = np.where(reach, np.arange(len(cuts)) + 1, 0).max(axis=1).clip(max=len(cuts) - 1)
    rows = np.argsort(-indexed, kind="stable")
    rows = rows[indexed[rows] > 0]  # row i of the block, those with the longest postings first
    score = np.zeros((len(q), len(rows)))
    for c in range(len(cuts) - 1):
        m = int((indexed[rows] > c).sum())
        a, b = cuts[c], cuts[c + 1]
        score[:, :m] += q[:, a:b] @ x[rows[:m], a:b].T
        seen = cuts[np.minimum(indexed[rows], c + 1)]
        within = score + q_rest[:, seen] * x_rest[rows, seen] + slack >= lowest[:, None]
        alive = within.any(axis=0)
        if not alive.all():
            rows, score, within = rows[alive], score[:, alive], within[:, alive]
    if not len(rows):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    i, j = np.nonzero(within)
    total, end = score[i, j], cuts[indexed[rows[j]]]
    for at in np.unique(end[end < width]):
        part = np.flatnonzero(end == at)
        for some in np.array_split(part, len(part) // 100_000 + 1):
            total[some] += np.einsum("pd,pd->p", q[i[some], at:], x[rows[j[some]], at:])
    keep = total >= lowest[i]
    return i[keep], rows[j[keep]], total[keep]


def best_in_windows(anchors: dict, rows: dict, same: bool, k: int) -> Iterator[tuple[np.ndarray, ...]]:
    """(anchor, window, row, score) of the first k rows in every window of every anchor of a block."""
    i, j, score = candidates(anchors["v"], anchors["lo"].min(axis=1), rows["v"])
    fits = ((anchors["label"][i] == rows["label"][j]) == same) & (anchors["id"][i] != rows["id"][j])
    i, j, score = i[fits], j[fits], score[fits]
    order = np.lexsort((rows["id"][j], -score, i))
    i, j, score = i[order], j[order], score[order]
    for w in range(anchors["lo"].shape[1]):
        use = np.flatnonzero((score >= anchors["lo"][i, w]) & (score <= anchors["hi"][i, w]))
        if len(use):
            first = np.r_[True, i[use][1:] != i[use][:-1]]
            start = np.flatnonzero(first)
            top = use[np.arange(len(use)) - start[np.cumsum(first) - 1] < k]
            yield i[top], np.full(len(top), w), j[top], score[top]


def _anchor_block(batch: pa.RecordBatch, width: int) -> dict:
    numbers = lambda name: batch.column(name).to_numpy(zero_copy_only=False).astype(np.int64)
    lists = lambda name, fill: np.array([[*x, *[fill] * 16][:slots] for x in batch.column(name).to_pylist()], np.float64)
    slots = max(len(x) for x in batch.column("lo").to_pylist())
    return {"v": matrix(batch.column("v"), width), "id": numbers("vec_id"), "label": numbers("label"), "key": numbers("key"), "lo": lists("lo", np.inf), "hi": lists("hi", np.inf), "w": lists("w", -1).astype(np.int64)}


FOUND = "key long, w long, score long, found_id long"


def searcher(path: str, width: int, same: bool, k: int):
    """Task function: blocks of rows against the anchors of a table in the shared folder."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, place = filesystem(path)
        for table in batches_of(batches, ROWS):
            rows = {"v": matrix(table.column("v"), width), "id": table.column("vec_id").to_numpy(), "label": table.column("label").to_numpy()}
            for anchors in ds.dataset(place, filesystem=files, format="parquet").to_batches(batch_size=ANCHORS):
                if not anchors.num_rows:
                    continue
                block = _anchor_block(anchors, width)
                for i, w, j, score in best_in_windows(block, rows, same, k):
                    yield pa.RecordBatch.from_pydict({"key": block["key"][i], "w": block["w"][i, w], "score": score.astype(np.int64), "found_id": rows["id"][j]})

    return search


def batches_of(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.Table]:
    """The rows of a task in tables of ``size`` rows."""
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        while n >= size:
            table = pa.Table.from_batches(held)
            yield table.slice(0, size)
            held, n = table.slice(size).to_batches(), n - size
    if n:
        yield pa.Table.from_batches(held)


def threshold_setter(sample: list, n_rows: int, width: int, same: bool, k: int, turn: int):
    """Task function: the windows of a search with their thresholds of this round."""
    x = np.zeros((len(sample), width))
    for r, row in enumerate(sample):
        x[r, : len(row.v)] = row.v
    labels, ids = np.array([r.label for r in sample], np.int64), np.array([r.vec_id for r in sample], np.int64)
    rank = int(np.ceil(3 * k * len(sample) / max(n_rows, 1))) * 8**turn

    def set_thresholds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            q = matrix(batch.column("v"), width)
            own, key = batch.column("label").to_numpy(), batch.column("vec_id").to_numpy()
            out = []
            for r, (his, floors) in enumerate(zip(batch.column("hi").to_pylist(), batch.column("floor").to_pylist())):
                score = np.sort((q[r] @ x.T)[((labels == own[r]) == same) & (ids != key[r])])[::-1]
                out.append([float(max(floor, below[rank - 1] if len(below := score[score <= hi]) >= rank else NONE)) for hi, floor in zip(his, floors)])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.list_(pa.float64()))], names=[*batch.schema.names, "lo"])

    return set_thresholds


def search_windows(rows: DataFrame, anchors: DataFrame, windows: DataFrame, same: bool, k: int, shape: tuple[int, list, int]) -> DataFrame:
    """(key, w, score, found_id, rank): the first k rows of every window.

    ``anchors``: (key, vec_id, label, v), ``windows``: (key, w, hi, floor: double). Rounds go on while a window that
    may still go down has less than k rows.
    """
    spark = rows.sparkSession
    width, sample, n_rows = shape
    left, done, turn = materialise(windows, "windows"), [], 0
    spec = "key long, vec_id long, label long, v array<long>, w array<long>, hi array<double>, floor array<double>, lo array<double>"
    while not left.isEmpty():
        grouped = left.groupBy("key").agg(F.collect_list(F.struct("w", "hi", "floor")).alias("z"))
        asked = anchors.join(grouped, "key").select("key", "vec_id", "label", "v", "z.w", "z.hi", "z.floor")
        path = scratch_path(spark, "anchors")
        asked.mapInArrow(threshold_setter(sample, n_rows, width, same, k, turn), spec).write.parquet(path)
        found = rows.mapInArrow(searcher(path, width, same, k), FOUND)
        rank = F.row_number().over(Window.partitionBy("key", "w").orderBy(F.desc("score"), "found_id"))
        found = materialise(found.withColumn("rank", rank).where(F.col("rank") <= k), "found")
        lows = spark.read.schema(spec).parquet(path).select("key", F.explode(F.arrays_zip("w", "lo", "floor")).alias("z")).select("key", "z.*")
        full = found.where(F.col("rank") == k).select("key", "w", F.lit(True).alias("full"))
        state = materialise(lows.join(full, ["key", "w"], "left").select("key", "w", (F.col("full").isNotNull() | (F.col("lo") <= F.col("floor"))).alias("over")), "state")
        done.append(found.join(state.where("over").select("key", "w"), ["key", "w"], "left_semi"))
        left = left.join(state.where("not over").select("key", "w"), ["key", "w"], "left_semi")
        turn += 1
    if not done:
        return spark.createDataFrame([], f"{FOUND}, rank int")
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    return out


def hard_negatives(rows: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    ``rows``: (vec_id, label, v) of ``prepare``. An anchor's positives are its best rows of the same label, a positive's
    negatives the best rows of other labels with low * positive <= 100 * negative <= high * positive.
    """
    rows = materialise(rows, "vectors")
    largest = F.max(F.coalesce(F.array_max(F.transform("v", F.abs)), F.lit(0)))
    n_rows, width, top = rows.agg(F.count("*"), F.coalesce(F.max(F.size("v")), F.lit(0)), F.coalesce(largest, F.lit(0))).first()
    if width * top * top >= 2**53:
        raise ValueError("scores of these components do not fit in 53 bits")
    sample = rows.orderBy(F.xxhash64("vec_id")).limit(SAMPLE).collect()  # at most SAMPLE rows
    shape = (max(width, 1), sample, n_rows)
    anchors = materialise(rows.where(is_anchor).distinct().select(F.xxhash64("vec_id", "label", "v").alias("key"), "*"), "anchors")
    ends = lambda lo, hi: [hi.cast("double").alias("hi"), lo.cast("double").alias("floor")]
    whole = anchors.select("key", F.lit(0).cast("long").alias("w"), *ends(F.lit(NONE), F.lit(np.inf)))
    near = materialise(search_windows(rows, anchors, whole, True, positives, shape), "positives")
    score = F.col("score")
    hi, lo = F.expr(f"(score * {high} - pmod(score * {high}, 100)) div 100"), F.expr(f"-((-score * {low} - pmod(-score * {low}, 100)) div 100)")
    bounds = near.select("key", score.alias("w"), *ends(lo, hi)).where("floor <= hi").distinct()
    far = search_windows(rows, anchors, bounds, False, negatives, shape)
    far = far.select("key", F.col("w").alias("positive_score"), "rank", F.col("found_id").alias("negative_id"), F.col("score").alias("negative_score"))
    pairs = near.select("key", score.alias("positive_score"), F.col("found_id").alias("positive_id"))
    named = anchors.select("key", F.col("vec_id").alias("anchor_id"))
    out = pairs.join(far, ["key", "positive_score"]).join(named, "key")
    return out.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")
