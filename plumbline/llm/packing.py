"""Best-fit packing of token pieces into sequences of a fixed capacity.

Only the histogram of piece lengths (at most ``capacity`` numbers) reaches the driver. Over it stands the
configuration linear program: as few sequences as possible, each filled by a pattern of lengths, so that
every piece is covered. Multiplicative weights solve it: in each round the most valuable pattern under the
current prices is found by the dynamic program of the knapsack problem, gets an equal share of the
sequences of the lower bound, and the prices of what it covers fall exponentially. The solution is rounded
down within the demand, and best-fit decreasing, done on counts of equal sequences, packs what is left.

The plan is a list of runs "ranks first.. of length l go to sequences base.. at an offset". Pieces get a
rank within their length without a shuffle of the pieces: each task numbers its own, and the counts per
task and length are summed up in order of tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.storage import materialise
from .encode import encoder
from .texts import as_text, text_slices

CAPACITY = 2048
ROUNDS = 256


def cut_documents(
    docs: DataFrame, tokenizer_path: str, space: str, end_id: int, capacity: int = CAPACITY, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """(id, piece, start, length, ids) of every document: its ids and ``end_id``, as unsigned 32-bit bytes.

    A document of at most ``capacity`` ids is one piece. A longer one is cut into pieces of ``capacity`` ids,
    of which the first may be shorter. A null or empty text has the end id only; repeated rows and ids stay
    separate rows; other columns are not read.
    """
    kind = docs.schema[id_column].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer_path, space)
        end = np.array([end_id], "<u4").tobytes()
        for batch in batches:
            text = as_text(batch.column(1))
            for a, b in text_slices(text):
                row, piece, start, length, ids = [], [], [], [], []
                for i, coded in enumerate(enc.encode(text.slice(a, b - a)), a):
                    coded += end
                    n = len(coded) // 4
                    cuts = [0, *range(n - (n - 1) // capacity * capacity, n + 1, capacity)]
                    for k, (x, y) in enumerate(zip(cuts, cuts[1:])):
                        row.append(i), piece.append(k), start.append(x), length.append(y - x), ids.append(coded[4 * x : 4 * y])
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(ids, pa.binary())], ["id", "piece", "start", "length", "ids"])

    plain = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"))
    return plain.mapInArrow(run, f"id {kind}, piece int, start long, length long, ids binary").withColumnRenamed("id", id_column)


def best_pattern(price: np.ndarray, capacity: int) -> dict[int, int]:
    """{length: number} of the most valuable pattern; ``price[l]`` is the value of a piece of length l."""
    best, choice = np.zeros(capacity + 1), np.zeros(capacity + 1, np.int64)
    for c in range(1, capacity + 1):
        value = price[1 : c + 1] + best[c - 1 :: -1] if c > 1 else price[1:2]
        k = int(value.argmax())
        if value[k] > best[c - 1]:
            best[c], choice[c] = value[k], k + 1
        else:
            best[c] = best[c - 1]
    pattern: dict[int, int] = {}
    c = capacity
    while c > 0:
        if choice[c]:
            pattern[int(choice[c])] = pattern.get(int(choice[c]), 0) + 1
            c -= int(choice[c])
        else:
            c -= 1
    return pattern


def fractional_cover(demand: np.ndarray, capacity: int, rounds: int, rate: float = 1.0) -> dict[tuple, float]:
    """{pattern: number of sequences} from multiplicative weights over ``demand[l]`` pieces of length l."""
    lengths = np.arange(capacity + 1)
    share = float((lengths * demand).sum()) / capacity / rounds
    log_weight = np.zeros(capacity + 1)
    worth = np.where(demand > 0, lengths / capacity, 0.0)
    out: dict[tuple, float] = {}
    for _ in range(rounds if share > 0 else 0):
        pattern = best_pattern(worth * np.exp(log_weight - log_weight[demand > 0].max()), capacity)
        for length, number in pattern.items():
            log_weight[length] -= rate * min(1.0, number * share / demand[length])
        key = tuple(sorted(pattern.items(), reverse=True))
        out[key] = out.get(key, 0.0) + share
    return out


def best_fit(demand: np.ndarray, capacity: int) -> list[tuple[dict[int, int], int]]:
    """Best-fit decreasing, done for all equal sequences at once: (pattern, number of sequences)."""
    groups: dict[int, list[tuple[dict[int, int], int]]] = {}
    free = np.zeros(capacity + 1, np.int64)

    def put(pattern, number, room):
        if number:
            groups.setdefault(room, []).append((pattern, number))
            free[room] += number

    for length in range(capacity, 0, -1):
        left = int(demand[length])
        while left:
            room = length + int((free[length:] > 0).argmax())
            if free[room]:
                pattern, number = groups[room].pop()
                free[room] -= number
            else:
                room, pattern, number = capacity, {}, left  # new sequences, at most one a piece
            each = room // length
            full = min(number, left // each)
            put({**pattern, length: each}, full, room - each * length)
            left -= full * each
            if full < number and left and left < each:
                put({**pattern, length: left}, 1, room - left * length)
                left, full = 0, full + 1
            if pattern:
                put(pattern, number - full, room)
    return [x for some in groups.values() for x in some]


def pack_histogram(demand: np.ndarray, capacity: int, rounds: int = ROUNDS) -> list[tuple[dict[int, int], int]]:
    """(pattern, number of sequences) that hold exactly ``demand[l]`` pieces of every length l."""
    left = demand.astype(np.int64).copy()
    out = []
    for pattern, number in sorted(fractional_cover(left, capacity, rounds).items(), key=lambda x: (-sum(a * b for a, b in x[0]), -x[1], x[0])):
        whole = min(int(number), *(int(left[length]) // each for length, each in pattern))
        if whole:
            out.append((dict(pattern), whole))
            for length, each in pattern:
                left[length] -= whole * each
    return out + best_fit(left, capacity)


def plan_runs(patterns: list[tuple[dict[int, int], int]]) -> dict[str, np.ndarray]:
    """Runs of ranks, sorted by length and first rank."""
    rows, ranks, base = [], {}, 0
    for pattern, number in patterns:
        offset = 0
        for length, each in sorted(pattern.items(), reverse=True):
            first = ranks.get(length, 0)
            rows.append((length, first, each, base, offset))
            ranks[length] = first + number * each
            offset += length * each
        base += number
    rows.sort()
    names = ("length", "first", "each", "base", "offset")
    return {n: np.array([r[i] for r in rows], np.int64) for i, n in enumerate(names)}


def pack(pieces: DataFrame, capacity: int = CAPACITY, rounds: int = ROUNDS) -> DataFrame:
    """``pieces`` (any rows with a ``length``) with sequence_id and offset, in as few sequences as it can.

    Places in a sequence are gapless from 0. Rows with a null length, or one outside 1..capacity, get null
    for both. Equal rows are packed one by one; an empty table stays empty.
    """
    columns = pieces.columns
    taken = {"__part", "__rank", "sequence_id", "offset"} & set(columns)
    if taken:
        raise ValueError(f"pieces has columns named {sorted(taken)}")

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seen = TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        at = columns.index("length")
        for batch in batches:
            length = batch.column(at).fill_null(0).to_numpy(zero_copy_only=False)
            length = np.where((length < 0) | (length > capacity), 0, length)
            order = np.argsort(length, kind="stable")
            ordered = length[order]
            begins = np.searchsorted(ordered, ordered)
            rank = np.empty(len(length), np.int64)
            rank[order] = np.arange(len(length)) - begins + seen[ordered]
            seen += np.bincount(length, minlength=capacity + 1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(len(length), part, np.int32)), pa.array(rank)], [*columns, "__part", "__rank"])

    schema = ", ".join(f"`{c}` {t}" for c, t in pieces.dtypes)
    numbered = materialise(pieces.mapInArrow(number, f"{schema}, __part int, __rank long"), "pieces")
    counts = numbered.where(F.col("length").between(1, capacity)).groupBy("__part", "length").count()
    demand = np.zeros(capacity + 1, np.int64)
    for length, n in counts.groupBy("length").agg(F.sum("count")).collect():  # at most ``capacity`` rows
        demand[length] = n
    runs = plan_runs(pack_histogram(demand, capacity, rounds))
    keys = runs["length"] << 40 | runs["first"]

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            t = pa.Table.from_batches([batch])
            length, rank = (t.column(c).fill_null(0).to_numpy() for c in ("length", "__rank"))
            lost = t.column("__before").is_null().to_numpy()
            rank = rank + t.column("__before").fill_null(0).to_numpy()
            run = np.searchsorted(keys, length << 40 | rank, side="right") - 1
            if len(keys):
                turn, slot = np.divmod(rank - runs["first"][run], runs["each"][run])
                found = runs["base"][run] + turn, runs["offset"][run] + slot * length
            else:
                found = rank, rank
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(columns)], *(pa.array(x, pa.int64(), mask=lost) for x in found)], [*columns, "sequence_id", "offset"])

    earlier = Window.partitionBy("length").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select("__part", "length", F.coalesce(F.sum("count").over(earlier), F.lit(0)).alias("__before"))
    ranked = numbered.join(before, ["__part", "length"], "left").select(*columns, "__rank", "__before")
    return ranked.mapInArrow(assign, f"{schema}, sequence_id long, offset long")
