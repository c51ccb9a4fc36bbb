"""Ids of whole texts through a ``tokenizers`` file, one unit at a time.

A unit is what stands between two places where the tokenizer certainly starts a new piece: a space, or a line
end, with other text on both sides. The joined ids of the units equal those of a call on the whole text: the split
pattern of the file never lets a piece cross such a place. Texts with other white space around such places are cut
only where a space stands alone.

Units repeat. Those of a block of bytes get 64-bit hashes from running sums and equal hashes become one unit (units
of more than ``keep_bytes`` bytes stay apart). A bounded memory has the ids of most distinct ones; only new ones are looked at
as text and encoded, in shared library calls. The ids of the block are then put together by offsets, so the work per unit is
a few array operations.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa

from .texts import SLICE_BYTES, as_text, polynomial, raw

#: A space between two characters that are not white space.
_PLACE = re.compile(r"(?<=\S)(?= \S)")

#: A random number per byte value, for the hashes of units.
_BYTES = np.random.default_rng(20240307).integers(1, 1 << 63, 256, dtype=np.uint64)

#: Signs that never share a piece with a letter before them.
_CLOSERS = tuple(",.;:!?")
_CLOSES, _LETTER = np.zeros(256, bool), np.zeros(256, bool)
_CLOSES[[ord(c) for c in _CLOSERS]] = True
_LETTER[ord("A") : ord("Z") + 1] = _LETTER[ord("a") : ord("z") + 1] = True


class UnitEncoder:
    """``space`` says what the file does with white space: "kept" (in front of words) or "dropped"."""

    def __init__(self, path: str, space: str, keep_units: int = 500_000, keep_bytes: int = 64):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        self.kept, self.keep_units, self.keep_bytes = space == "kept", keep_units, keep_bytes
        self.memory: dict[int, bytes] = {}  # ids of units by hash
        self.unsafe: set[int] = set()  # hashes of those that begin or end with other white space
        self.odd: dict[str, bytes] = {}  # ids of units of texts with other white space
        self.closers: dict[str, bytes] = {}
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=False)
        self.marked = np.zeros(self.tokenizer.get_vocab_size() + 1, bool)  # pieces that begin, or end, a word
        self.marked[[i for piece, i in vocabulary.items() if (piece[0] == "Ġ" if self.kept else piece.endswith("</w>"))]] = True

    def _call(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, "<u4") for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _library(self, units: list[str], front: str) -> Iterator[tuple[str, bytes]]:
        """Ids of each unit behind ``front``. Words of letters share calls: marks in the vocabulary tell them apart."""
        words = [u for u in units if u.lower().isalpha()] if front or not self.kept else []
        calls = [words[i : i + 256] for i in range(0, len(words), 256)]
        alone: list[str] = []
        for call, ids in zip(calls, self._call(["".join(" " + u for u in c)[not self.kept :] for c in calls])):
            edges = np.flatnonzero(self.marked[ids])
            cuts = np.append(edges, len(ids)) if self.kept else np.concatenate([[0], edges + 1])
            if len(cuts) == len(call) + 1 and cuts[0] == 0 and cuts[-1] == len(ids):
                data = ids.tobytes()
                yield from ((u, data[4 * x : 4 * y]) for u, x, y in zip(call, cuts.tolist(), cuts[1:].tolist()))
            else:  # some word is more than one piece to the library
                alone += call
        joined = set(words)
        rest = alone + [u for u in units if u not in joined]
        for i in range(0, len(rest), 4096):
            some = rest[i : i + 4096]
            yield from ((u, ids.tobytes()) for u, ids in zip(some, self._call([front + u for u in some])))

    def _learn(self, memory: dict[str, bytes], units: Iterable[str], front: str = "") -> dict[str, bytes]:
        """``memory`` with the ids of the units that it lacked."""
        new = {u for u in units if u not in memory}
        ended = {u for u in new if u[-1:] in _CLOSERS and u[-2:-1].lower().isalpha()}  # a word and its full stop or comma
        new |= {u[:-1] for u in ended if u[:-1] not in memory}
        for closer in {u[-1] for u in ended} - self.closers.keys():
            self.closers[closer] = self._call([closer])[0].tobytes()
        memory.update(self._library([u for u in new if u not in ended], front))
        memory.update((u, memory[u[:-1]] + self.closers[u[-1]]) for u in ended)
        return memory

    def _ids_of(self, units: list[bytes]) -> list[bytes | None]:
        """Ids of units, each with the space or line end before it; None where white space makes them unsafe."""
        texts = [u.decode() for u in units]
        if not self.kept:
            return list(map(self._learn({}, texts).__getitem__, texts))
        safe = [not (t[t[0] in " \n" :][0].isspace() or t[-1].isspace()) for t in texts]
        spaced = self._learn({}, (t[1:] for t, ok in zip(texts, safe) if ok and t[0] == " "), " ")
        bare = self._learn({}, ["\n", *(t[t[0] == "\n" :] for t, ok in zip(texts, safe) if ok and t[0] != " ")])
        ids = {" ": lambda t: spaced[t[1:]], "\n": lambda t: bare["\n"] + bare[t[1:]]}
        return [ids.get(t[0], bare.__getitem__)(t) if ok else None for t, ok in zip(texts, safe)]

    def _block(self, data: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, number of ids, whether safe) of the units data[first:last]."""
        key = polynomial(data, first, last, _BYTES)
        long = np.flatnonzero(last - first > self.keep_bytes)
        key[long] += long.astype(np.uint64)
        code, distinct = pd.factorize(key)
        unit = np.empty(len(distinct), np.int64)
        unit[code[::-1]] = np.arange(len(code))[::-1]  # the first with each code
        names = distinct.tolist()
        coded = list(map(self.memory.get, names))
        new = [i for i, c in enumerate(coded) if c is None]
        some = data.tobytes()
        begin, end = first[unit[new]].tolist(), last[unit[new]].tolist()
        for i, a, b, ids in zip(new, begin, end, self._ids_of([some[a:b] for a, b in zip(begin, end)])):
            coded[i] = ids or b""
            if ids is None:
                self.unsafe.add(names[i])
            if b - a <= self.keep_bytes:
                self.memory[names[i]] = coded[i]
        safe = ~np.isin(distinct, np.array(list(self.unsafe), np.uint64)) if self.unsafe else np.ones(len(distinct), bool)
        size = np.array(list(map(len, coded)), np.int64) // 4
        return join_runs(np.frombuffer(b"".join(coded), "<u4"), size, code), size[code], safe[code]

    def encode(self, texts: list[str] | pa.Array) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text; blocks of about ``SLICE_BYTES`` are worked on at once."""
        texts = as_text(texts if isinstance(texts, pa.Array) else pa.array(texts, pa.large_string()))
        data, offsets = raw(texts)
        out, first, n_ids, safe = [], [], [], []
        for a, b in blocks(data, offsets):
            begin, end = units(data, offsets, a, b, self.kept)
            ids, size, good = self._block(data[a:b], begin - a, end - a)
            out.append(ids), first.append(begin), n_ids.append(size), safe.append(good)
        joined = np.concatenate(out).tobytes() if out else b""
        begin = np.concatenate(first) if first else np.zeros(0, np.int64)
        total = np.concatenate([[0], *n_ids]).astype(np.int64).cumsum()
        edges = np.searchsorted(begin, offsets)
        cuts = (4 * total[edges]).tolist()
        result = [joined[x:y] for x, y in zip(cuts, cuts[1:])]
        if self.kept:
            for i in self._unsafe(data, offsets, begin, np.concatenate([*safe, [True]])):
                parts = _PLACE.split(texts[i].as_py())
                result[i] = b"".join(map(self._learn(self.odd, parts).__getitem__, parts))
                for unit in parts:
                    if len(unit) > self.keep_bytes:
                        self.odd.pop(unit, None)
        if len(self.memory) + len(self.unsafe) + len(self.odd) > self.keep_units:
            self.memory.clear(), self.unsafe.clear(), self.odd.clear()
        return result

    def _unsafe(self, data: np.ndarray, offsets: np.ndarray, begin: np.ndarray, safe: np.ndarray) -> list[int]:
        """Texts with white space other than single spaces or line ends between two units."""
        edge = is_edge(data)
        double = np.flatnonzero(edge[1:] & edge[:-1]) + 1
        full = offsets[1:] > offsets[:-1]
        bad = np.zeros(len(offsets) - 1, bool)
        bad[full] = edge[offsets[:-1][full]] | edge[offsets[1:][full] - 1]
        for places in (double, begin[~safe[: len(begin)]]):
            bad[np.searchsorted(offsets, places, side="right") - 1] = True
        return np.flatnonzero(bad).tolist()


def is_edge(data: np.ndarray) -> np.ndarray:
    return (data == 0x20) | (data == 0x0A)


def blocks(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, int]]:
    """Byte ranges of about ``SLICE_BYTES`` that begin at a space, a line end or a text."""
    a = 0
    while a < len(data):
        b = len(data)
        step = SLICE_BYTES
        while a + step < len(data):
            edge = np.flatnonzero(is_edge(data[a + 1 : a + step]))
            text = offsets[max(0, np.searchsorted(offsets, a + step) - 1)]
            cut = max(a + 1 + int(edge[-1]) if len(edge) else a, int(text))
            if cut > a:
                b = cut
                break
            step *= 2  # one unit is longer than this
        yield a, b
        a = b


def units(data: np.ndarray, offsets: np.ndarray, a: int, b: int, kept: bool) -> tuple[np.ndarray, np.ndarray]:
    """(start, stop) of the units in data[a:b]; with ``kept`` the space or line end in front belongs to a unit.

    A closing sign behind a letter from A to z is a unit of its own.
    """
    inside = ~is_edge(data[a:b])
    cuts = offsets[np.searchsorted(offsets, a, side="right") : np.searchsorted(offsets, b)] - a  # texts begin here
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    first[cuts] |= inside[cuts]
    last[cuts - 1] |= inside[cuts - 1]
    start, stop = np.flatnonzero(first), np.flatnonzero(last) + 1
    if kept:
        text = np.zeros(b - a + 1, bool)
        text[cuts] = True
        text[0] = True  # a block begins with the space of its first unit or with a text
        start = start - ~text[start]
    here = data[a:b]
    ended = np.flatnonzero(_CLOSES[here[stop - 1]] & _LETTER[here[np.maximum(stop - 2, start)]])
    starts, stops = np.insert(start, ended + 1, stop[ended] - 1), np.insert(stop, ended, stop[ended] - 1)
    return starts + a, stops + a


def join_runs(pool: np.ndarray, size: np.ndarray, which: np.ndarray) -> np.ndarray:
    """The runs ``which`` of ``pool``, which holds runs of the given sizes, one behind the other."""
    start = np.cumsum(size) - size
    length = size[which]
    behind = np.cumsum(length)
    shift = np.repeat(start[which] - (behind - length), length)
    return pool[shift + np.arange(len(shift))]


_ENCODERS: dict[tuple[str, str], UnitEncoder] = {}


def encoder(path: str, space: str) -> UnitEncoder:
    """One encoder per Python worker, kept between its tasks."""
    if (path, space) not in _ENCODERS:
        _ENCODERS[path, space] = UnitEncoder(path, space)
    return _ENCODERS[path, space]
