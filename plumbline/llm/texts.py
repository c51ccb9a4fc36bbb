"""Texts inside Arrow tasks: batches balanced by bytes, words and shingles as 64-bit hashes.

A word is a run of bytes outside space and 0x09-0x0D, with A-Z lowered. Everything here works on
the UTF-8 bytes of a bounded slice of rows, so memory follows the slice and not the batch. Word
hashes are polynomials modulo 2**64 over random byte values, taken from running sums and mixed; a
collision of two different words has a chance of about 2**-64 times the square of their number.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text handled at once.
SLICE_BYTES = 1 << 20

_SEED = np.random.default_rng(20240229)
_VALUES = _SEED.integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_VALUES[ord("A") : ord("Z") + 1] = _VALUES[ord("a") : ord("z") + 1]
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS[0]) < n:
        size = max(n, SLICE_BYTES + 1024)
        pair = _powers(_BASE, size), _powers(_INVERSE, size)
        if size > 4 * SLICE_BYTES:  # one very long text: not kept
            return pair
        _POWERS[:] = pair
    return _POWERS[0], _POWERS[1]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser, element-wise."""
    x = x.copy()
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def text_slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """(start, stop) row ranges of at most ``limit`` bytes; one longer text is a range of its own."""
    if not len(column):
        return
    size = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    start = 0
    while start < len(size):
        before = size[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(size, before + limit, side="right")))
        yield start, stop
        start = stop


def as_text(column) -> pa.Array:
    """A string column as one array of utf8 values without nulls (null: empty)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    return column.fill_null("") if column.null_count else column


def raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a slice of a large_string array, without a copy."""
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    if data is None:
        return np.zeros(0, np.uint8), at - at[0]
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]], at - at[0]


def polynomial(data: np.ndarray, start: np.ndarray, stop: np.ndarray, values: np.ndarray) -> np.ndarray:
    """64-bit hashes of data[start:stop], from running sums over one number per byte value."""
    power, inverse = _tables(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    with np.errstate(over="ignore"):
        np.cumsum(values[data] * power[: len(data)], out=total[1:])
        value = (total[stop] - total[start]) * inverse[start]
        return mix(value ^ (stop - start).astype(np.uint64) * _BASE)


class Words:
    """Words of a slice of texts: byte ``start`` and ``stop``, ``doc`` (row in the slice), ``hash``."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.data, self.n_docs = data, len(offsets) - 1
        word = ~_SPACE[data]
        first, last = word.copy(), word.copy()
        first[1:] &= ~word[:-1]
        last[:-1] &= ~word[1:]
        cuts = offsets[1:-1]
        cuts = cuts[(cuts > 0) & (cuts < len(data))]
        first[cuts] |= word[cuts]  # a text begins here
        last[cuts - 1] |= word[cuts - 1]
        self.start, self.stop = np.flatnonzero(first), np.flatnonzero(last) + 1
        self.doc = np.searchsorted(offsets, self.start, side="right") - 1
        self.hash = polynomial(data, self.start, self.stop, _VALUES)
        self.per_doc = np.bincount(self.doc, minlength=self.n_docs)

    def shingles(self, width: int) -> tuple[np.ndarray, np.ndarray]:
        """(row, hash) of every run of ``width`` words; a text with fewer words gives one run of all."""
        n = len(self.hash)
        if not n:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        ends = np.cumsum(self.per_doc)
        left = ends[self.doc] - np.arange(n)  # words from here to the end of the text
        begin = np.flatnonzero((left >= width) | ((left == self.per_doc[self.doc]) & (left < width)))
        length = np.minimum(left[begin], width)
        out = np.zeros(len(begin), np.uint64)
        with np.errstate(over="ignore"):
            for k in range(width):
                use = length > k
                step = self.hash[np.minimum(begin + k, n - 1)]
                out = np.where(use, mix(out * _BASE + step + np.uint64(k)), out)
        return self.doc[begin], out

    def word(self, i: int) -> bytes:
        """The lowered bytes of word ``i``."""
        return self.data[self.start[i] : self.stop[i]].tobytes().lower()


def words_of(column: pa.Array) -> Words:
    return Words(*raw(column))


def sliced_words(column: pa.Array) -> Iterator[tuple[int, int, Words]]:
    """(start, stop, words) of the byte-balanced slices of a column."""
    column = as_text(column)
    for start, stop in text_slices(column):
        yield start, stop, words_of(column.slice(start, stop - start))


def as_signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)
