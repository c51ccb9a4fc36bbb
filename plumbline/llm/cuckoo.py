"""Cuckoo filters of one shard: chains of equal tables of 16-bit fingerprints, as whole-array numpy steps.

A key is two 64-bit hashes. It has one fingerprint and two buckets, each the other's partner by the fingerprint alone,
so entries of equal fingerprint and bucket pair stand for one another and every stored key owns one of them. A full
table is followed by another of the same size and hashing; deletions may therefore take the entry of either.
"""

from __future__ import annotations

import numpy as np

BUCKETS = 1 << 12
SLOTS = 4
#: Rounds of eviction before the rest goes to the next table.
ROUNDS = 60


def places(h1: np.ndarray, h2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(fingerprint, bucket) of keys given as two signed 64-bit hashes."""
    print_ = (h2.view(np.uint64) >> np.uint64(48)).astype(np.uint16)
    print_[print_ == 0] = 1  # 0 is an empty slot
    return print_, ((h1.view(np.uint64) >> np.uint64(20)) & np.uint64(BUCKETS - 1)).astype(np.int64)


def partner(print_: np.ndarray, bucket: np.ndarray) -> np.ndarray:
    return bucket ^ ((print_.astype(np.int64) * 0x5BD1E995 >> 7) & (BUCKETS - 1))


def rank_in_runs(key: np.ndarray) -> np.ndarray:
    """Position of each element among equal neighbours of a sorted array."""
    new = np.r_[True, key[1:] != key[:-1]]
    start = np.flatnonzero(new)
    return np.arange(len(key)) - start[np.cumsum(new) - 1]


def load(data: bytes | None) -> np.ndarray:
    """Tables (chain, bucket, slot) of a stored filter; none for null."""
    flat = np.frombuffer(data or b"", np.uint16)
    return flat.reshape(-1, BUCKETS, SLOTS).copy()


def contains(tables: np.ndarray, print_: np.ndarray, bucket: np.ndarray) -> np.ndarray:
    found = np.zeros(len(print_), bool)
    for table in tables:
        for at in (bucket, partner(print_, bucket)):
            found |= (table[at] == print_[:, None]).any(axis=1)
    return found


def _fill(table: np.ndarray, print_: np.ndarray, bucket: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Store what fits; returns the entries left over after ``ROUNDS`` of eviction."""
    for turn in range(ROUNDS):
        order = np.argsort(bucket, kind="stable")
        print_, bucket = print_[order], bucket[order]
        free = table[bucket] == 0
        rank = rank_in_runs(bucket)
        fits = rank < free.sum(axis=1)
        slot = (free & (np.cumsum(free, axis=1) == (rank + 1)[:, None])).argmax(axis=1)
        table[bucket[fits], slot[fits]] = print_[fits]
        print_, bucket = print_[~fits], bucket[~fits]
        if not len(print_):
            break
        if turn:  # both buckets were full: the first in each bucket takes the place of an entry
            evict = np.flatnonzero(rank_in_runs(bucket) == 0)
            held = table[bucket[evict], turn % SLOTS]
            table[bucket[evict], turn % SLOTS] = print_[evict]
            print_[evict] = held
        bucket = partner(print_, bucket)
    return print_, bucket


def insert(tables: np.ndarray, print_: np.ndarray, bucket: np.ndarray) -> np.ndarray:
    """The filter with one more entry per key; the last table first, then new ones."""
    chain = list(tables)
    if chain:
        print_, bucket = _fill(chain[-1], print_, bucket)
    while len(print_):
        chain.append(np.zeros((BUCKETS, SLOTS), np.uint16))
        print_, bucket = _fill(chain[-1], print_, bucket)
    return np.stack(chain) if chain else tables


def delete(tables: np.ndarray, print_: np.ndarray, bucket: np.ndarray) -> int:
    """Take one entry per key out, in place; returns how many keys had none."""
    bucket = np.minimum(bucket, partner(print_, bucket))
    order = np.argsort(bucket << 16 | print_)
    print_, bucket = print_[order], bucket[order]
    for table in tables:
        for side in (0, 1):
            at = partner(print_, bucket) if side else bucket
            same = table[at] == print_[:, None]
            rank = rank_in_runs(bucket << 16 | print_)
            hit = rank < same.sum(axis=1)
            slot = (same & (np.cumsum(same, axis=1) == (rank + 1)[:, None])).argmax(axis=1)
            table[at[hit], slot[hit]] = 0
            print_, bucket = print_[~hit], bucket[~hit]
            if not len(print_):
                return 0
    return len(print_)
