"""A compressor's language model: logistic mixing of hashed-context bit predictors.

A text is a row of tokens (words with A-Z lowered, then one end). The model predicts the bytes of a token bit by
bit, the word end included. Five predictors look at the last one, two, three or four bytes and at the whole token
so far; each keeps counts of zeros and ones in a table that is indexed by a hash of its context and the bits of
the current byte. Their stretched probabilities are added with weights; the weight set is chosen by a gate (how
much the longer contexts have seen), learned online by gradient steps, and the mix is refined by an adaptive
probability map over the partial byte and the mixed probability. Inside a text the model adapts once more: a
token's probability is (tau * P + times seen in this text) / (tau + tokens so far), which is again a
distribution over texts and does not depend on the order of the tokens. A sixth predictor knows the whole token so
far in one group of texts (a language); a text's probability is the mean over the groups.

Scale: the corpus is read twice. The first time every task counts its words; counts per distinct word come from
one aggregation. Everything the model learns comes from that table, each word weighted by its count. The predictors'
counts are a Spark table that grows with the distinct words: an entry is a 64-bit key of a context and the next
symbol, not a place in an array, so contexts do not share slots. Batches of words send their entries by ranges of
keys, a range adds them up, and every batch gets back the states of its own entries' bits. Weights are averaged over tasks, the map is a sum. All
words are scored once. The second time texts are scored: the most frequent words travel with the tasks in a table of fixed
size, every other word of a text meets its score in a join on its hash. No text is shuffled.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.storage import materialise
from .texts import as_signed, mix, sliced_words

#: Slots of each predictor's table, as powers of two, for a model that is held in one array; ``score_texts`` has none.
TABLE_BITS = (16, 20, 20, 20, 21, 22)
#: Words and symbols of a batch, and the entries meant for a range of keys.
BATCH_WORDS, BATCH_SYMBOLS, RANGE_ENTRIES = 8192, 1 << 17, 1 << 18
SIZES = [1 << b for b in TABLE_BITS]
STARTS = np.concatenate([[0], np.cumsum(SIZES)]).astype(np.int64)
N_INPUTS = len(TABLE_BITS) + 1
#: Steps of the gate: of the whole token so far, and of the last four and three bytes.
_GATE4 = np.array([0, 1, 2, 3, 3, 4, 4, 4, 4, 4, 4, 5, 5, 6, 7, 7])
_GATE3 = np.array([0, 0, 0, 1, 1, 1, 1, 1, 1, 1, 1, 1, 1, 2, 2, 2])
GATES = 8 * 3 * 8
MAP_STEPS = 64
#: Entries of the table of frequent words (24 bytes each).
FREQUENT = 1 << 17
TAU = 3000.0
#: Most groups of texts that get a predictor of their own.
MAX_GROUPS = 6

WORD_END, TEXT_END = 0x20, 0x0A
_END_WORD = bytes([TEXT_END])

#: A state is a level (how often the slot was seen, 16 steps) and 12 bits: up to 10 sights the number of ones, else
#: the stretched share of ones in steps of 1/128.
_LEVELS = np.array([11, 21, 51, 201, 2001])
DELTA = 0.4


def states_of(counts: np.ndarray) -> np.ndarray:
    """16-bit states of (slots, 2) counts of zeros and ones."""
    pair = counts.reshape(-1, 2).astype(np.float64)
    seen = pair.sum(axis=1)
    stretched = np.log((pair[:, 1] + DELTA) / (pair[:, 0] + DELTA))
    steps = np.clip(np.rint(stretched * 128) + 2048, 0, 4095)
    level = np.where(seen <= 10, seen, 10 + np.digitize(seen, _LEVELS))
    return (level.astype(np.uint16) << np.uint16(12)) | np.where(seen <= 10, pair[:, 1], steps).astype(np.uint16)


def _lookups() -> tuple[np.ndarray, np.ndarray]:
    level, low = np.divmod(np.arange(1 << 16), 1 << 12)
    few, ones = level <= 10, np.minimum(low, level)
    plain = np.where(few, np.log((ones + DELTA) / (level - ones + DELTA)), (low - 2048) / 128)
    without = [plain.copy(), plain.copy()]  # one zero less, one one less
    zeros = np.maximum(level - ones - 1, 0)
    without[0][few] = np.log((ones + DELTA) / (zeros + DELTA))[few]
    without[1][few] = np.log((np.maximum(ones - 1, 0) + DELTA) / (level - ones + DELTA))[few]
    return plain.astype(np.float32), np.stack(without).astype(np.float32)


_STRETCH, _WITHOUT = _lookups()


def spell(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(symbols, starts) of binary words: their bytes and a word end; the end of a text is one symbol."""
    offsets = np.frombuffer(words.buffers()[1], np.int32)[words.offset : words.offset + len(words) + 1].astype(np.int64)
    data = np.frombuffer(words.buffers()[2], np.uint8)[offsets[0] : offsets[-1]] if words.buffers()[2] is not None else np.zeros(0, np.uint8)
    offsets -= offsets[0]
    size = np.diff(offsets)
    plain = ~((size == 1) & (data[np.minimum(offsets[:-1], max(len(data) - 1, 0))] == TEXT_END)) if len(data) else np.ones(len(size), bool)
    starts = np.concatenate([[0], np.cumsum(size + plain)])
    out = np.full(starts[-1], WORD_END, np.uint8)
    out[np.arange(len(data)) + np.repeat(starts[:-1] - offsets[:-1], size)] = data
    return out, starts


def context_hashes(symbols: np.ndarray, starts: np.ndarray) -> list[np.ndarray]:
    """For the five common predictors, a 64-bit hash of the context before every symbol; the first is the last byte."""
    n = len(symbols)
    begin = np.repeat(starts[:-1], np.diff(starts))
    place = np.arange(n) - begin
    last = np.zeros(n, np.uint64)
    out = []
    for k in range(1, 5):
        before = np.zeros(n, np.uint64)
        before[k:] = symbols[:-k]
        before[place < k] = 0
        last |= before << np.uint64(8 * (k - 1))
        out.append(last.copy() if k == 1 else mix(last + np.uint64(k << 56)))
    base = np.uint64(0x9E3779B97F4A7C15)
    power = np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(max(n - 1, 0), base)]).astype(np.uint64))
    inverse = np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(max(n - 1, 0), np.uint64(pow(int(base), -1, 1 << 64)))]).astype(np.uint64))
    total = np.concatenate([[np.uint64(0)], np.cumsum((symbols.astype(np.uint64) + np.uint64(1)) * power[:n])])
    out.append(mix(((total[:n] - total[begin]) * inverse[begin]) ^ (place.astype(np.uint64) << np.uint64(57))))
    return out


def slot(hashes: np.ndarray, node: np.ndarray, k: int) -> np.ndarray:
    """Place in predictor ``k``'s part of the joined tables for the context and the bits of the byte so far."""
    if k == 0:
        return (hashes << np.uint64(8) | node).astype(np.int64)
    key = (hashes + node * np.uint64(0xD6E8FEB86659FD93)) * np.uint64(0x9FB21C651E98DF25)
    return (key >> np.uint64(64 - TABLE_BITS[k])).astype(np.int64) + STARTS[k]


def in_group(hashes: np.ndarray, group) -> np.ndarray:
    """Context of the sixth predictor: the whole token so far, in texts of a group."""
    return mix(hashes + (np.atleast_1d(group).astype(np.uint64) + np.uint64(1)) * np.uint64(0xC2B2AE3D27D4EB4F))


@dataclass
class Model:
    """State of the tables (one 16-bit number a slot), weights per gate and the adaptive map."""

    tables: np.ndarray = field(default_factory=lambda: np.zeros(STARTS[-1], np.uint16))
    weights: np.ndarray = field(default_factory=lambda: np.concatenate([np.tile([0.05, 0.05, 0.1, 0.1, 0.3, 0.4], (GATES, 1)), np.zeros((GATES, 1))], axis=1).astype(np.float32))
    refine: np.ndarray = field(default_factory=lambda: np.zeros((256 * MAP_STEPS, 2)))

    def __post_init__(self):
        centre = 1 / (1 + np.exp(-(np.arange(256 * MAP_STEPS) % MAP_STEPS - MAP_STEPS / 2 + 0.5) / 4))
        self.mapped = ((self.refine[:, 1] + 20 * centre) / (self.refine.sum(axis=1) + 20)).astype(np.float32)

    def inputs(self, places, bit, leave_out):
        """(inputs, gate) of a step; ``leave_out`` takes one sight of the bit itself out of the counts."""
        x = np.ones((N_INPUTS, len(bit)), np.float32)
        levels = []
        for k, at in enumerate(places):
            state = self.tables[at]
            level = (state >> 12).astype(np.intp)
            if leave_out:
                x[k] = _WITHOUT[bit.view(np.int8), state]
                level -= (level > 0) & (level <= 10)
            else:
                x[k] = _STRETCH[state]
            levels.append(level)
        return x, (_GATE4[levels[4]] * 3 + _GATE3[levels[3]]) * 8 + (_GATE4[levels[5]] if len(levels) > 5 else 0)

    def mixed(self, x, gate):
        total = np.einsum("kn,nk->n", x, self.weights[gate])
        return np.clip(total, -12, 12)

    @staticmethod
    def map_place(node, total):
        return node * MAP_STEPS + np.clip((total * 4 + MAP_STEPS / 2).astype(np.int64), 0, MAP_STEPS - 1)


def as_planes(x: np.ndarray) -> bytes:
    """Numbers compressed byte by byte of their width: high bytes, which vary little, lie side by side."""
    flat = np.ascontiguousarray(x).reshape(-1)
    return pa.compress(flat.view(np.uint8).reshape(-1, flat.itemsize).T.tobytes(), "zstd", asbytes=True)


def from_planes(data: bytes, n: int, kind) -> np.ndarray:
    width = np.dtype(kind).itemsize
    planes = np.frombuffer(pa.decompress(data, n * width, "zstd"), np.uint8).reshape(width, n)
    return np.ascontiguousarray(planes.T).view(kind).reshape(-1)


class Slots:
    """The entries (key of a context, next symbol) of a batch of words: of the contexts of one to four bytes, then of whole tokens.

    The states of an entry's eight bits lie in one array: for the first kind once, for whole tokens once for all texts
    and once for each group.
    """

    def __init__(self, words: pa.Array, groups: int):
        self.symbols, self.starts = spell(words)
        self.groups = groups
        parts, size = [], 0
        self.common = []
        for k, h in enumerate(context_hashes(self.symbols, self.starts)):
            key = mix(h + np.uint64((k + 1) * 0xD1B54A32D192ED03 % (1 << 64)))
            found, place = np.unique(key + self.symbols * np.uint64(0xD6E8FEB86659FD93), return_inverse=True)
            first = np.empty(len(found), np.int64)  # any place of an entry: all have its key and symbol
            first[place] = np.arange(len(place))
            parts.append((key[first], self.symbols[first]))
            self.common.append(place + size)
            size += len(first)
        self.whole = self.common.pop() - (size - len(parts[4][0]))
        self.entries = [tuple(np.concatenate(x) for x in zip(*parts[:4])), parts[4]]
        self.n, self.m = len(self.entries[0][0]), len(self.entries[1][0])

    def counts(self, c: np.ndarray) -> list[np.ndarray]:
        """Counts of the entries, (entries, 1) and (entries, groups), from those of the words by group."""
        each = np.repeat(c.astype(np.uint64), np.diff(self.starts), axis=0)
        out = [np.zeros((self.n, 1), np.uint64), np.zeros((self.m, self.groups), np.uint64)]
        for at in self.common:
            np.add.at(out[0][:, 0], at, each.sum(axis=1))
        for g in range(self.groups):
            np.add.at(out[1][:, g], self.whole, each[:, g])
        return out

    def by_range(self, bits: int) -> Iterator[tuple[int, int, np.ndarray]]:
        """(range, kind, entries in order of keys) by the first bits of their keys; ranges of whole tokens have numbers of their own."""
        for kind, (keys, _) in enumerate(self.entries):
            order = np.argsort(keys)
            r = (keys >> np.uint64(64 - bits)).astype(np.int64)
            cuts = np.concatenate([[0], np.cumsum(np.bincount(r, minlength=1 << bits))])
            for k in np.flatnonzero(np.diff(cuts)).tolist():
                yield k + (kind << bits), kind, order[cuts[k] : cuts[k + 1]]

    def states(self, answers: dict[int, bytes], bits: int) -> np.ndarray:
        out = [np.empty((1, 8, self.n), np.uint16), np.empty((1 + self.groups, 8, self.m), np.uint16)]
        for r, kind, at in self.by_range(bits):
            shape = (len(out[kind]), 8, len(at))
            out[kind][:, :, at] = np.frombuffer(pa.decompress(answers[r], 2 * math.prod(shape), "zstd"), np.uint16).reshape(shape)
        return np.concatenate([x.ravel() for x in out])

    def shared(self, k: int, at=slice(None)) -> list[np.ndarray]:
        """Places of bit ``k`` for the predictors that all groups share."""
        return [*(k * self.n + x[at] for x in self.common), 8 * self.n + k * self.m + self.whole[at]]

    def own(self, k: int, group, at=slice(None)) -> np.ndarray:
        return 8 * self.n + ((1 + group) * 8 + k) * self.m + self.whole[at]

    def of(self, row: np.ndarray, group: np.ndarray):
        """Function from a bit's number to the predictors' places, for words ``row`` in texts of ``group``."""
        size = np.diff(self.starts)[row]
        at = np.arange(size.sum()) + np.repeat(self.starts[row] - np.cumsum(size) + size, size)
        group = np.repeat(group, size)
        return lambda k: [*self.shared(k, at), self.own(k, group, at)]


def entry_states(keys: np.ndarray, symbols: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """States (columns, 8, entries) of the bits of entries, whose ``counts`` (entries, columns) may come in several parts."""
    order = np.lexsort((symbols, keys))
    key, symbol, c = keys[order], symbols[order].astype(np.int64), counts[order]
    new = np.concatenate([[True], key[1:] != key[:-1]])
    out = np.empty((c.shape[1], 8, len(keys)), np.uint16)
    for k in range(8):
        node = symbol >> (8 - k)
        first = np.flatnonzero(new | np.concatenate([[True], node[1:] != node[:-1]]))
        size = np.diff(np.concatenate([first, [len(key)]]))
        one = (symbol >> (7 - k) & 1).astype(np.uint64)
        for j in range(c.shape[1]):
            pair = np.stack([np.add.reduceat(c[:, j] * (1 - one), first), np.add.reduceat(c[:, j] * one, first)], axis=1)
            out[j, k, order] = np.repeat(states_of(pair), size)
    return out


def steps(symbols: np.ndarray, starts: np.ndarray, group: np.ndarray | None = None, found=None) -> Iterator[tuple]:
    """(node, bit, places) for each of the eight bits of all symbols; ``group``: of each token, ``found``: see Slots.of."""
    hashes = context_hashes(symbols, starts) if found is None else []
    if group is not None and found is None:
        hashes.append(in_group(hashes[4], np.repeat(group, np.diff(starts))))
    value = symbols.astype(np.int64)
    for k in range(8):
        node = 1 << k | value >> (8 - k)
        code = node.astype(np.uint64)
        yield node, (value >> (7 - k) & 1).astype(bool), found(k) if found else [slot(h, code, i) for i, h in enumerate(hashes)]


def word_log2(model: Model, words: pa.Array, groups: int, slots: Slots | None = None) -> np.ndarray:
    """log2 of the model's probability of each word, its end included, in texts of each group: (groups, words)."""
    symbols, starts = spell(words)
    out = np.zeros((groups, len(words)))
    if not len(symbols):
        return out
    own = [] if slots else [in_group(context_hashes(symbols, starts)[4], g) for g in range(groups)]
    for k, (node, bit, places) in enumerate(steps(symbols, starts, found=slots and slots.shared)):
        x, gate = model.inputs(places, bit, False)
        for g in range(groups):
            state = model.tables[slots.own(k, g) if slots else slot(own[g], node.astype(np.uint64), 5)]
            x[5] = _STRETCH[state]
            total = model.mixed(x, gate + _GATE4[state >> 12])
            p = 0.5 / (1 + np.exp(-total)) + 0.5 * model.mapped[model.map_place(node, total)]
            p = np.clip(p, 1e-6, 1 - 1e-6)
            out[g] += np.add.reduceat(np.log2(np.where(bit, p, 1 - p)), starts[:-1])
    return out


def add_counts(counts: np.ndarray, words: pa.Array, group: np.ndarray, weight: np.ndarray, found=None) -> None:
    """Add the bits of words, seen ``weight`` times each in texts of ``group``, to a (slots, 2) table of counts."""
    symbols, starts = spell(words)
    each = np.repeat(weight, np.diff(starts)).astype(counts.dtype)
    for _, bit, places in steps(symbols, starts, group, found):
        for at in places:
            np.add.at(counts, 2 * at + bit, each)


def learn_weights(model: Model, words: pa.Array, group: np.ndarray, weight: np.ndarray, rate: float, found=None) -> None:
    """One online step per bit position over a small batch; a word's own sight is left out of the counts."""
    symbols, starts = spell(words)
    each = np.repeat(np.sqrt(weight), np.diff(starts)).astype(np.float32)
    for _, bit, places in steps(symbols, starts, group, found):
        x, gate = model.inputs(places, bit, True)
        error = (bit - 1 / (1 + np.exp(-model.mixed(x, gate)))) * each
        norm = np.bincount(gate, each, GATES) + 10.0
        for k in range(N_INPUTS):
            model.weights[:, k] += (rate * np.bincount(gate, error * x[k], GATES) / norm).astype(np.float32)


def add_refinement(model: Model, sums: np.ndarray, words: pa.Array, group: np.ndarray, weight: np.ndarray, found=None) -> None:
    symbols, starts = spell(words)
    each = np.repeat(weight, np.diff(starts)).astype(np.float64)
    for node, bit, places in steps(symbols, starts, group, found):
        x, gate = model.inputs(places, bit, True)
        at = model.map_place(node, model.mixed(x, gate))
        sums += np.bincount(2 * at + bit, each, 2 * 256 * MAP_STEPS)


def count_words(docs: DataFrame, groups: int) -> DataFrame:
    """(hash, word, c) of all tokens of ``docs`` (text, train, group): c lists the counts in training rows by group."""
    names = [f"c{g}" for g in range(groups)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            train = batch.column(1).to_numpy(zero_copy_only=False).astype(bool)
            group = batch.column(2).to_numpy()
            ends = np.bincount(group[train], minlength=groups)
            yield pa.RecordBatch.from_arrays([pa.array([end_hash()]), pa.array([_END_WORD], pa.binary()), *(pa.array([int(x)], pa.int64()) for x in ends)], ["hash", "word", *names])
            for start, stop, words in sliced_words(batch.column(0)):
                hashes, first, inverse = np.unique(words.hash, return_index=True, return_inverse=True)
                learned = train[start:stop][words.doc]
                place = (inverse * groups + group[start:stop][words.doc])[learned]
                c = np.bincount(place, minlength=len(hashes) * groups).reshape(-1, groups)
                yield pa.RecordBatch.from_arrays([pa.array(as_signed(hashes)), lowered(words, first), *(pa.array(np.ascontiguousarray(c[:, g])) for g in range(groups))], ["hash", "word", *names])

    seen = docs.mapInArrow(run, "hash long, word binary, " + ", ".join(f"{n} long" for n in names))
    return seen.groupBy("hash", "word").agg(*(F.sum(n).alias(n) for n in names)).select("hash", "word", F.array(*names).alias("c"))


def end_hash() -> int:
    return int(as_signed(mix(np.array([TEXT_END], np.uint64)))[0])


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32


def lowered(words, which: np.ndarray) -> pa.Array:
    """The lowered bytes of some words, as one binary array."""
    size = words.stop[which] - words.start[which]
    offsets = np.concatenate([[0], np.cumsum(size)])
    at = np.arange(offsets[-1]) + np.repeat(words.start[which] - offsets[:-1], size)
    data = _LOWER[words.data[at]]
    return pa.Array.from_buffers(pa.binary(), len(which), [None, pa.py_buffer(offsets.astype(np.int32).tobytes()), pa.py_buffer(data.tobytes())])


WORD_FIELDS = "batch long, hash array<long>, word array<binary>, c array<long>"


def batched(words: DataFrame) -> DataFrame:
    """(batch, hash, word, c, n, distinct): words (hash, word, c) in batches, c group by group; n tokens in training rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = TaskContext.get().partitionId() << 32
        for batch in batches:
            c = batch.column("c").flatten().to_numpy().reshape(batch.num_rows, -1)
            size = np.cumsum(pc.binary_length(batch.column("word")).to_numpy().astype(np.int64) + 1)
            start = 0
            while start < len(size):
                most = np.searchsorted(size, (size[start - 1] if start else 0) + BATCH_SYMBOLS, side="right")
                stop = max(start + 1, min(start + BATCH_WORDS, int(most)))
                some, part = c[start:stop], batch.slice(start, stop - start)
                one = lambda x: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x)
                lists = [one(part.column("hash")), one(part.column("word").take(pa.array(np.arange(stop - start)))), one(pa.array(some.ravel()))]
                yield pa.RecordBatch.from_arrays([pa.array([at]), *lists, pa.array([int(some.sum())]), pa.array([int(some.any(axis=1).sum())])], ["batch", "hash", "word", "c", "n", "distinct"])
                at, start = at + 1, stop

    return words.sortWithinPartitions("word").mapInArrow(run, WORD_FIELDS + ", n long, distinct long")


def unpacked(batches: Iterator[pa.RecordBatch], groups: int, bits: int = 0) -> Iterator[tuple]:
    """(batch, hash, words, counts, slots, states) of every batch of words; states where ``bits`` is given."""
    for batch in batches:
        for i in range(batch.num_rows):
            words = batch.column("word")[i].values
            counts = batch.column("c")[i].values.to_numpy().reshape(len(words), groups)
            slots, states = Slots(words, groups), None
            if bits:
                answers = batch.column("answers")[i].values
                states = slots.states(dict(zip(answers.field("range").to_pylist(), answers.field("states").to_pylist())), bits)
            yield batch.column("batch")[i].as_py(), batch.column("hash")[i].values, words, counts, slots, states


def learned(counts: np.ndarray, words: pa.Array, slots: Slots, rows: int) -> Iterator[tuple]:
    """(words, group, count, places) of at most ``rows`` words that were seen in training rows."""
    row, group = np.nonzero(counts)
    for i in range(0, len(row), rows):
        some, own = row[i : i + rows], group[i : i + rows]
        yield words.take(pa.array(some)), own, counts[some, own], slots.of(some, own)


def range_bits(words: int) -> int:
    """Bits of a range number: about RANGE_ENTRIES entries a range, at some eight for each word."""
    return max(7, math.ceil(math.log2(max(1, words * 8 / RANGE_ENTRIES))))


def with_states(words: DataFrame, groups: int, bits: int) -> DataFrame:
    """``words`` (batches) with answers: the states of their entries, from the counts of all batches."""

    def request(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, _, _, c, slots, _ in unpacked(batches, groups):
            counts, rows = slots.counts(c), []
            for r, kind, at in slots.by_range(bits):
                keys, symbols = slots.entries[kind]
                rows.append((batch, r, as_planes(np.diff(keys[at], prepend=np.uint64(0))), symbols[at].tobytes(), pa.compress(counts[kind][at].T.tobytes(), "zstd", asbytes=True)))
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), (pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary()))], ["batch", "range", "keys", "symbols", "counts"])

    def settle(t: pa.Table) -> pa.Table:
        columns = groups if t.column("range")[0].as_py() >> bits else 1
        symbols = t.column("symbols").to_pylist()
        keys = [np.cumsum(from_planes(x, len(s), np.uint64)) for s, x in zip(symbols, t.column("keys").to_pylist())]
        symbols = np.frombuffer(b"".join(symbols), np.uint8)
        counts = np.concatenate([np.frombuffer(pa.decompress(x, 8 * columns * len(k), "zstd"), np.uint64).reshape(columns, -1).T for k, x in zip(keys, t.column("counts").to_pylist())])
        if t.column("range")[0].as_py() >> bits:
            counts = np.concatenate([counts.sum(axis=1, keepdims=True), counts], axis=1)
        states = entry_states(np.concatenate(keys), symbols, counts)
        parts = np.split(states, np.cumsum([len(x) for x in keys])[:-1], axis=2)
        return pa.table({"batch": t.column("batch"), "range": t.column("range"), "states": pa.array([pa.compress(x.tobytes(), "zstd", asbytes=True) for x in parts], pa.binary())})

    asked = words.select("batch", "hash", "word", "c").mapInArrow(request, "batch long, range int, keys binary, symbols binary, counts binary")
    settled = asked.groupBy("range").applyInArrow(settle, "batch long, range int, states binary")
    answers = settled.groupBy("batch").agg(F.collect_list(F.struct("range", "states")).alias("answers"))
    return materialise(words.select("batch", "hash", "word", "c").join(answers, "batch"), "word-states")


def train(known: DataFrame, groups: int, bits: int, rows: int = 512, rate: float = 0.02):
    """(weights, refinement sums) from batches of words with their states."""
    start = Model(np.zeros(0, np.uint16)).weights

    def weights(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, total = Model(np.zeros(0, np.uint16), start.copy()), 0.0
        for _, _, some, counts, slots, own.tables in unpacked(batches, groups, bits):
            for words, group, c, found in learned(counts, some, slots, rows):
                learn_weights(own, words, group, c, rate, found)
                total += float(len(c))
        if total:
            yield pa.RecordBatch.from_pydict({"i": np.arange(own.weights.size), "v": own.weights.ravel().astype(float) * total, "n": np.full(own.weights.size, total)})

    parts = known.mapInArrow(weights, "i long, v double, n double").groupBy("i").agg(F.sum("v"), F.sum("n")).collect()
    mean = start.copy()
    for i, v, n in parts:
        mean.ravel()[i] = v / n

    def refine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, sums = Model(np.zeros(0, np.uint16), mean), np.zeros(2 * 256 * MAP_STEPS)
        for _, _, some, counts, slots, own.tables in unpacked(batches, groups, bits):
            for words, group, c, found in learned(counts, some, slots, rows * 8):
                add_refinement(own, sums, words, group, c, found)
        at = np.flatnonzero(sums)
        yield pa.RecordBatch.from_pydict({"i": at, "v": sums[at]})

    refined = np.zeros(2 * 256 * MAP_STEPS)
    for i, v in known.mapInArrow(refine, "i long, v double").groupBy("i").agg(F.sum("v")).collect():
        refined[i] = v
    return mean, refined.reshape(-1, 2)


def gain(p: np.ndarray, n: np.ndarray, tau: float) -> np.ndarray:
    """log10 of the product of (tau * p + j) for j < n."""
    out = np.log10(tau * p)
    many = n > 1
    a, m = tau * p[many], n[many]
    extra = np.zeros(len(a))
    for j in range(1, int(min(m.max(initial=1), 32))):
        extra += np.where(j < m, np.log10(a + j), 0)
    long = m > 32
    if long.any():
        lgamma = np.vectorize(math.lgamma, otypes=[float])
        extra[long] += (lgamma(a[long] + m[long]) - lgamma(a[long] + 32)) / np.log(10)
    out[many] += extra
    return out


def group_index(docs: DataFrame, group, most: int):
    """(column of group numbers, how many): the ``most`` - 1 largest groups of training rows, and one for the rest."""
    if group is None:
        return F.lit(0), 1
    top = [r[0] for r in docs.where("train").groupBy("group").count().orderBy(F.desc("count"), "group").limit(most + 1).collect()]
    if not top:
        return F.lit(0), 1
    names = [x for x in top if x is not None]
    if len(top) > most:
        names = names[: most - 1]
    index = F.lit(len(names))
    for k, name in enumerate(names):
        index = F.when(F.col("group") == F.lit(name), k).otherwise(index)
    return index, len(names) + (len(names) < len(top))


def score_texts(docs: DataFrame, train_on, group=None, tau: float = TAU, frequent: int = FREQUENT, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, train, n_tokens, n_known, train_tokens, base_score, score, n_bytes, bits_per_byte) of every row.

    ``train_on`` is a boolean column over ``docs``; rows where it is true are learned from (null: not). ``group``, if
    given, is a column (such as the language) of which only training rows are looked at: each group gets its
    own predictor, and a text's probability is the mean over the groups. base_score is the sum over tokens of
    log10((c + 0.1) / (N + 0.1 * (V + 1))), score the model's log10 probability of the text. A null text is
    empty: its only token is the end. Repeated ids and rows stay separate rows; a null id stays null; other
    columns are not read. Without training rows all counts are 0 and the model is uniform. bits_per_byte counts
    a byte between words and is null for an empty text.
    """
    spark = docs.sparkSession
    kind = docs.schema[id_column].dataType.simpleString()
    plain = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"), F.coalesce(train_on, F.lit(False)).alias("train"), (F.lit(0) if group is None else group).alias("group"))
    index, groups = group_index(plain, group, MAX_GROUPS)
    plain = plain.withColumn("group", F.when(F.col("train"), index).otherwise(0).cast("int"))
    words = materialise(batched(count_words(plain.select("text", "train", "group"), groups)), "words")
    n_all, n_distinct, n_words = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("distinct"), F.lit(0)), F.coalesce(F.sum(F.size("word")), F.lit(0))).first()
    bits = range_bits(n_words)
    words = with_states(words, groups, bits)
    weights, refined = train(words, groups, bits)
    numbers = [f"p{g}" for g in range(groups)]

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(np.zeros(0, np.uint16), weights, refined)
        for _, hashes, some, counts, slots, model.tables in unpacked(batches, groups, bits):
            p = np.exp2(word_log2(model, some, groups, slots))
            yield pa.RecordBatch.from_arrays([hashes, pa.array(counts.sum(axis=1)), *(pa.array(x) for x in p)], ["hash", "c", *numbers])

    p_fields = ", ".join(f"{n} double" for n in numbers)
    scored = materialise(words.mapInArrow(weigh, f"hash long, c long, {p_fields}"), "word-scores")
    top = scored.orderBy(F.desc("c"), "hash").limit(frequent).toArrow().sort_by("hash")  # at most ``frequent`` rows
    table = spark.sparkContext.broadcast(tuple(top.column(c).to_numpy() for c in ("hash", "c", *numbers)))
    end = scored.where(F.col("hash") == end_hash()).first()
    end_c, end_p = (end.c, [end[n] for n in numbers]) if end else (0, [1.0] * groups)
    base_unit = n_all + 0.1 * (n_distinct + 1)

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, counts, *ps = table.value
        part, at = TaskContext.get().partitionId(), 0
        for batch in batches:
            for start, stop, w in sliced_words(batch.column(1)):
                n_docs = stop - start
                order = np.lexsort((w.hash, w.doc))
                doc, key = w.doc[order], as_signed(w.hash[order])
                first = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (key[1:] != key[:-1])])) if len(doc) else np.zeros(0, np.int64)
                n = np.diff(np.concatenate([first, [len(doc)]])).astype(np.int64)
                doc, key = doc[first], key[first]
                found = np.minimum(np.searchsorted(hashes, key), max(len(hashes) - 1, 0))
                known = hashes[found] == key if len(hashes) else np.zeros(len(key), bool)
                found, own, times = found[known], doc[known], n[known]
                add = lambda v: np.bincount(own, v, n_docs)
                tokens = w.per_doc + 1
                history = np.concatenate([[0], np.cumsum(np.log10(tau + np.arange(tokens.max())))])[tokens]
                base = add(times * np.log10((counts[found] + 0.1) / base_unit)) + np.log10((end_c + 0.1) / base_unit)
                scores = [add(gain(p[found], times, tau)) + np.log10(tau * e) - history for p, e in zip(ps, end_p)]
                n_known = add(times * (counts[found] > 0)) + (end_c > 0)
                size = np.zeros(n_docs + 1, np.int64)
                np.cumsum(np.bincount(doc[~known], minlength=n_docs), out=size[1:])
                lists = [pa.ListArray.from_arrays(pa.array(size.astype(np.int32)), pa.array(x[~known])) for x in (key, n)]
                row = (part << 40) + at + np.arange(n_docs)
                at += n_docs
                n_bytes = np.bincount(w.doc, w.stop - w.start + 1, n_docs).astype(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(row), batch.column(0).slice(start, n_docs), batch.column(2).slice(start, n_docs), *(pa.array(x) for x in (tokens.astype(np.int64), n_known.astype(np.int64), n_bytes, base, *scores)), *lists],
                    ["row", "id", "train", "n_tokens", "n_known", "n_bytes", "base", *(f"s{g}" for g in range(groups)), "rare", "times"],
                )

    s_fields = ", ".join(f"s{g} double" for g in range(groups))
    texts = materialise(plain.mapInArrow(look, f"row long, id {kind}, train boolean, n_tokens long, n_known long, n_bytes long, base double, {s_fields}, rare array<long>, times array<long>"), "text-scores")
    rare = texts.select("row", F.explode(F.arrays_zip("rare", "times")).alias("w")).select("row", F.col("w.rare").alias("hash"), F.col("w.times").alias("n"))

    def repeated(p):
        again = F.aggregate(F.sequence(F.lit(1), F.col("n").cast("int") - 1), F.lit(0.0), lambda s, j: s + F.log10(F.lit(tau) * p + j))
        return F.log10(F.lit(tau) * p) + F.when(F.col("n") > 1, again).otherwise(0.0)

    rest = rare.join(scored, "hash").groupBy("row").agg(
        F.sum(F.when(F.col("c") > 0, F.col("n")).otherwise(0)).alias("known"),
        F.sum(F.col("n") * F.log10((F.col("c") + 0.1) / F.lit(base_unit))).alias("base_rest"),
        *(F.sum(repeated(F.col(p))).alias(f"more_{p}") for p in numbers),
    )
    out = texts.drop("rare", "times").join(rest, "row", "left")
    for g in range(groups):
        out = out.withColumn(f"s{g}", F.col(f"s{g}") + F.coalesce(f"more_p{g}", F.lit(0.0)))
    out = out.withColumn("top", F.greatest(*(f"s{g}" for g in range(groups))) if groups > 1 else F.col("s0"))
    shares = sum((F.pow(F.lit(10.0), F.col(f"s{g}") - F.col("top")) for g in range(1, groups)), F.pow(F.lit(10.0), F.col("s0") - F.col("top")))
    out = out.withColumn("score", F.col("top") + F.log10(shares / groups))
    return out.select(
        F.col("id").alias(id_column), "train", "n_tokens", (F.col("n_known") + F.coalesce("known", F.lit(0))).cast("long").alias("n_known"), F.lit(int(n_all)).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("base_rest", F.lit(0.0))).alias("base_score"), "score", "n_bytes", F.when(F.col("n_bytes") > 0, -F.col("score") / F.lit(float(np.log10(2))) / F.col("n_bytes")).alias("bits_per_byte"),
    )
