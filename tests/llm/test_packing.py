import zlib

import numpy as np
import pytest

from plumbline.llm import packing
from plumbline.llm.registry import vocabulary

SCHEMA = "doc_id long, text string, length string, piece string"


def check_whole(demand, patterns, capacity):
    held = np.zeros(capacity + 1, np.int64)
    for pattern, number in patterns:
        assert number > 0 and sum(a * b for a, b in pattern.items()) <= capacity
        for length, each in pattern.items():
            held[length] += each * number
    assert (held == demand).all()


@pytest.mark.parametrize("seed", range(6))
def test_histograms_are_packed_whole_and_tight(seed):
    rng = np.random.default_rng(seed)
    capacity = 256
    demand = np.zeros(capacity + 1, np.int64)
    sizes = np.clip(rng.lognormal(4, 1, 4000), 1, capacity).astype(int)
    np.add.at(demand, sizes, 1)
    patterns = packing.pack_histogram(demand, capacity, 64)
    check_whole(demand, patterns, capacity)
    bound = int(np.ceil((np.arange(capacity + 1) * demand).sum() / capacity))
    big = int(demand[capacity // 2 + 1 :].sum())
    assert sum(n for _, n in patterns) <= max(bound, big) * 1.01 + 1


def test_small_histograms_reach_the_optimum():
    def optimum(sizes, capacity):
        best = [len(sizes)]

        def place(i, rooms):
            if len(rooms) >= best[0]:
                return
            if i == len(sizes):
                best[0] = len(rooms)
                return
            for k in range(len(rooms)):
                if rooms[k] >= sizes[i]:
                    place(i + 1, [*rooms[:k], rooms[k] - sizes[i], *rooms[k + 1 :]])
            place(i + 1, [*rooms, capacity - sizes[i]])

        place(0, [])
        return best[0]

    rng = np.random.default_rng(1)
    over = 0
    for _ in range(15):
        sizes = sorted(rng.integers(1, 16, 9), reverse=True)
        demand = np.bincount(sizes, minlength=17)
        patterns = packing.pack_histogram(demand, 16, 24)
        check_whole(demand, patterns, 16)
        over += sum(n for _, n in patterns) - optimum(sizes, 16)
    assert over <= 1


def test_best_pattern_is_the_knapsack_optimum():
    price = np.array([0, 0.1, 0.35, 0.0, 0.72, 0.0, 1.0])
    found = packing.best_pattern(price, 6)
    assert found == {2: 1, 4: 1}


def test_documents_become_gapless_sequences(spark):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(vocabulary("byte_bpe_50k.json"))
    texts = [None, "", "a b", "word " * 300, "word " * 63 + "x", *["tie tie"] * 40, "é" * 500]
    docs = spark.createDataFrame([(i, t, "x", "y") for i, t in enumerate(texts)] + [(2, "a b", "x", "y"), (None, "z", None, None)], SCHEMA).repartition(4)
    cut = packing.cut_documents(docs, vocabulary("byte_bpe_50k.json"), "kept", 0, capacity=64)
    rows = packing.pack(cut, capacity=64, rounds=16).collect()
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    assert set(by_doc) == {*range(len(texts)), None} and len(by_doc[2]) == 2
    for i, t in enumerate(texts):
        if i == 2:
            continue
        ids = [*plain.encode(t or "", add_special_tokens=False).ids, 0]
        pieces = sorted(by_doc[i], key=lambda r: r.piece)
        assert b"".join(bytes(p.ids) for p in pieces) == np.array(ids, "<u4").tobytes()
        assert [p.piece for p in pieces] == list(range(len(pieces)))
        assert [p.start for p in pieces] == list(np.cumsum([0] + [p.length for p in pieces])[:-1])
        assert all(p.length == 64 for p in pieces[1:]) and 1 <= pieces[0].length <= 64
        assert zlib.crc32(bytes(pieces[0].ids)) >= 0
    for some in by_sequence.values():
        place = 0
        for r in sorted(some, key=lambda r: r.offset):
            assert r.offset == place
            place += r.length
        assert place <= 64
    total = sum(r.length for r in rows)
    assert len(by_sequence) <= -(-total // 64) + 1


def test_lengths_that_do_not_fit_and_empty_tables(spark):
    rows = packing.pack(spark.createDataFrame([(1, None), (2, 0), (3, 65), (4, 64), (5, 3)], "k int, length long"), capacity=64).collect()
    assert sorted(r.k for r in rows if r.sequence_id is None) == [1, 2, 3]
    assert packing.pack(spark.createDataFrame([], "length long"), capacity=64).count() == 0
    with pytest.raises(ValueError):
        packing.pack(spark.createDataFrame([], "length long, offset int"))
