import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from plumbline.llm import mixing

SCHEMA = "doc_id long, text string, lang string, score string"


def tokens(text):
    return [*re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower()), b"\n"]


def frame(spark, rows):
    return spark.createDataFrame([(d, t, lang, "x") for d, t, lang in rows], SCHEMA).repartition(3)


ROWS = [(i, " ".join(["the", "of", f"w{i % 7}", "And"] * (i % 5 + 1)), "en") for i in range(40)] + [
    (100 + i, " ".join(["der", "und", f"w{i % 3}"] * (i % 4 + 1)), "de" if i % 2 else None) for i in range(30)
] + [(200, None, "en"), (201, "", "en"), (202, "new  WORDS\there " * 300, None), (203, "the " * 100, None), (None, "the", "en"), (7, "again 7", "en"), (7, "again 7", "en")]


def test_counts_and_base_scores_equal_brute_force(spark):
    held = F.col("doc_id") % 4 == 2
    got = mixing.score_texts(frame(spark, ROWS), ~held, group=F.col("lang"), frequent=3).collect()
    counts = Counter()
    for d, t, _ in ROWS:
        if d is not None and d % 4 != 2:
            counts.update(tokens(t))
    n, v = sum(counts.values()), len(counts)
    expected = []
    for d, t, _ in ROWS:
        base = sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in tokens(t))
        expected.append((str(d), len(tokens(t)), sum(counts[w] > 0 for w in tokens(t)), n, round(base, 6)))
    assert sorted((str(r.doc_id), r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == sorted(expected)
    assert all(r.score < 0 and math.isfinite(r.score) for r in got)
    assert {r.doc_id for r in got if r.bits_per_byte is None} == {200, 201}


def test_scores_do_not_depend_on_which_words_travel_with_the_tasks(spark):
    docs = frame(spark, ROWS)
    few, all_words = ({(r.doc_id, r.n_tokens): r.score for r in mixing.score_texts(docs, F.lit(True), frequent=k).collect()} for k in (2, 1000))
    assert few.keys() == all_words.keys()
    assert all(abs(few[k] - all_words[k]) < 1e-6 for k in few)


def small_model():
    words, group, c = pa.array([b"ab", b"abc", b"b", b"\n"], pa.binary()), np.array([0, 1, 0, 0]), np.array([50, 20, 30, 10])
    counts = np.zeros(2 * mixing.STARTS[-1], np.uint32)
    mixing.add_counts(counts, words, group, c)
    model = mixing.Model(mixing.states_of(counts))
    for _ in range(20):
        mixing.learn_weights(model, words, group, c, 0.05)
    sums = np.zeros(2 * 256 * mixing.MAP_STEPS)
    mixing.add_refinement(model, sums, words, group, c)
    return mixing.Model(model.tables, model.weights, sums.reshape(-1, 2))


def test_probabilities_of_all_next_bytes_sum_to_one():
    model = small_model()
    one = [bytes([x]) for x in range(256) if x not in (0x20, mixing.TEXT_END)]
    # P(first byte): a word's probability without its end, by dividing the end out
    words = pa.array([*one, b"\n"], pa.binary())
    symbols, starts = mixing.spell(words)
    total = 0.0
    for w in range(len(words)):
        p = 1.0
        for node, bit, places in mixing.steps(symbols[starts[w] : starts[w] + 1], np.array([0, 1]), np.array([0])):
            x, gate = model.inputs(places, bit, False)
            mixed = model.mixed(x, gate)
            q = 0.5 / (1 + np.exp(-mixed)) + 0.5 * model.mapped[model.map_place(node, mixed)]
            p *= float(q[0] if bit[0] else 1 - q[0])
        total += p
    space = symbols[:1].copy()
    space[0] = 0x20
    p = 1.0
    for node, bit, places in mixing.steps(space, np.array([0, 1]), np.array([0])):
        x, gate = model.inputs(places, bit, False)
        mixed = model.mixed(x, gate)
        q = 0.5 / (1 + np.exp(-mixed)) + 0.5 * model.mapped[model.map_place(node, mixed)]
        p *= float(q[0] if bit[0] else 1 - q[0])
    assert total + p == pytest.approx(1, abs=1e-4)


def test_seen_words_and_their_group_are_likelier():
    model = small_model()
    logs = mixing.word_log2(model, pa.array([b"ab", b"abc", b"zq"], pa.binary()), 2)
    assert logs[0, 0] > logs[0, 2] + 3 and logs[1, 1] > logs[0, 1]
    assert mixing.word_log2(model, pa.array([], pa.binary()), 2).shape == (2, 0)


def test_repeats_follow_the_product_formula():
    p, n = np.array([0.01, 0.2, 1e-7]), np.array([1, 5, 200])
    expected = [sum(math.log10(30 * a + j) for j in range(b)) for a, b in zip(p, n)]
    assert np.allclose(mixing.gain(p, n, 30.0), expected)


def test_no_rows_and_no_training(spark):
    assert mixing.score_texts(frame(spark, []), F.lit(True)).count() == 0
    rows = mixing.score_texts(frame(spark, ROWS[:3]), F.lit(False)).collect()
    assert [r.train_tokens for r in rows] == [0, 0, 0] and all(r.n_known == 0 and r.score < 0 for r in rows)


def states_in_spark(spark, rows, groups):
    """{(word, group, predictor, bit): [state per symbol]} from the Spark table of slots."""
    known = spark.createDataFrame(rows, "hash long, word binary, c array<long>").repartition(3)
    bits, out = mixing.range_bits(len(rows)), {}
    batches = [pa.RecordBatch.from_struct_array(x.to_struct_array()) for x in mixing.with_states(mixing.batched(known), groups, bits).toArrow().combine_chunks().to_batches()]
    for _, _, words, _, slots, states in mixing.unpacked(batches, groups, bits):
        for w, word in enumerate(words.to_pylist()):
            for g in range(groups):
                for bit in range(8):
                    for k, at in enumerate(slots.of(np.array([w]), np.array([g]))(bit)):
                        out[word, g, k, bit] = states[at].tolist()
    return out


def test_large_counts_keep_their_ratio(spark):
    for unit in (1 << 21, 1 << 33):
        states = states_in_spark(spark, [(1, b"a", [3 * unit]), (2, b"b", [unit])], 1)
        for k in range(6):  # bit 6 tells a from b
            assert float(mixing._STRETCH[states[b"a", 0, k, 6][0]]) == pytest.approx(-math.log(3), abs=0.01)


def test_contexts_do_not_share_slots_however_many_words(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BATCH_WORDS", 700)
    rows = [(i, f"{i * 7919 % 100003:05d}x{i}".encode(), [i % 3, 1 + i % 2]) for i in range(3000)]
    exact = Counter()
    for _, word, c in rows:
        for at, symbol in enumerate(word + b" "):
            for g, n in enumerate(c):
                for bit in range(8):
                    node, one = 1 << bit | symbol >> (8 - bit), symbol >> (7 - bit) & 1
                    for k, context in enumerate([*(word[max(0, at - j) : at] for j in range(1, 5)), word[:at], (g, word[:at])]):
                        exact[k, context, node, one] += n
    got = states_in_spark(spark, rows, 2)
    for _, word, _ in rows[::97]:
        for at, symbol in enumerate(word + b" "):
            for bit in range(8):
                node = 1 << bit | symbol >> (8 - bit)
                for g in range(2):
                    for k, context in enumerate([*(word[max(0, at - j) : at] for j in range(1, 5)), word[:at], (g, word[:at])]):
                        counts = np.array([exact[k, context, node, 0], exact[k, context, node, 1]])
                        assert got[word, g, k, bit][at] == mixing.states_of(counts)[0]


def test_entries_travel_in_order_of_keys_and_by_planes():
    rng = np.random.default_rng(4)
    for kind in (np.uint16, np.uint64):
        x = rng.integers(0, 1 << 16, (3, 8, 11)).astype(kind)
        assert np.array_equal(mixing.from_planes(mixing.as_planes(x), x.size, kind).reshape(x.shape), x)
    assert len(mixing.from_planes(mixing.as_planes(np.zeros(0, np.uint16)), 0, np.uint16)) == 0
    words = pa.array([f"{i * 7919 % 1009}ab{i % 13}".encode() for i in range(400)], pa.binary())
    slots = mixing.Slots(words, 2)
    seen = {0: [], 1: []}
    for r, kind, at in slots.by_range(7):
        keys = slots.entries[kind][0][at]
        assert np.all(np.diff(keys.astype(object)) >= 0) and set((keys >> np.uint64(57)).tolist()) == {r - (kind << 7)}
        seen[kind] += at.tolist()
    assert [sorted(seen[k]) for k in (0, 1)] == [list(range(slots.n)), list(range(slots.m))]
    keys = np.sort(slots.entries[0][0])
    assert len(mixing.as_planes(np.diff(keys, prepend=np.uint64(0)))) < 0.8 * keys.nbytes
