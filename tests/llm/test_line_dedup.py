import hashlib
import random

import numpy as np
import pytest

from plumbline.llm import cuckoo, line_dedup
from plumbline.llm.queries import op11_line_dedup

SPACE = " \t\n\x0b\x0c\r"


def key_of(line):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(SPACE))


def brute(rows, min_length=10):
    """[(doc_id, n_lines, n_dropped, text)]: a null id is one more document after all others."""
    holders = {}
    for doc, text in rows:
        for line in (text or "").split("\n"):
            if len(key_of(line)) >= min_length:
                holders.setdefault(key_of(line), set()).add((doc is None, doc))
    out = []
    for doc, text in rows:
        lines = (text or "").split("\n")
        gone = [len(h) > 1 and (doc is None, doc) != min(h, key=lambda x: (x[0], x[1] or 0)) if (h := holders.get(key_of(x))) else False for x in lines]
        out.append((doc, len(lines), sum(gone), "\n".join(x for x, g in zip(lines, gone) if not g)))
    return sorted(out, key=str)


def kept(index, docs):
    return sorted((tuple(r) for r in line_dedup.kept_texts(index, docs).collect()), key=str)


SCHEMA = "doc_id long, text string"
ODD = [
    (5, "A common LINE here\nshort\n\nown line of five"), (2, "  a common line here\t\nshort\nA common line here"), (9, None), (3, ""),
    (None, "a common line here\nonly of null ids"), (None, "only of null ids\nonly of null ids"), (7, "ÄÖÜ äöüß é\nx"), (8, "äöü äöüß é\nÄÖÜ äöüß é"),
    (4, "same text twice\ntail"), (4, "same text twice\ntail"), (4, "another text\nsame text twice"), (6, "same text twice\r\n\x0bsame text twice"), (10, "123456789\n1234567890"), (11, "123456789\n 1234567890 "),
]


def test_odd_rows(spark):
    docs = spark.createDataFrame(ODD, SCHEMA)
    assert kept(line_dedup.new_index(docs), docs) == brute(ODD)


def test_empty_table_and_extra_columns(spark):
    docs = spark.createDataFrame([], SCHEMA)
    assert kept(line_dedup.new_index(docs), docs) == []
    rows = [(1, "a line of some length", "x"), (2, "a line of some length", "y")]
    wide = spark.createDataFrame(rows, "doc_id long, text string, position string").selectExpr("*", "1 as row", "2 as h1", "3 as gone", "4 as n_lines")
    assert kept(line_dedup.new_index(wide), wide) == brute([r[:2] for r in rows])


def test_inserts_and_deletions_equal_a_new_index(spark):
    rng = random.Random(4)
    words = [f"a line with number {i}" for i in range(60)] + ["x", "", "the line of all of them"]
    make = lambda ids: [(i, "\n".join(["The line of all of them"] * (rng.random() < 0.7) + rng.choices(words, k=rng.randrange(6)))) for i in ids]
    frame = lambda rows: spark.createDataFrame(rows, SCHEMA)
    held = make(range(40))
    index = line_dedup.new_index(frame(held), shards=3)
    for step in range(3):
        more = make(range(100 * step + 50, 100 * step + 80))
        index, held = line_dedup.insert(index, frame(more)), held + more
        out = rng.sample([d for d, _ in held], 20) + [999_999]
        index, held = line_dedup.delete(index, frame([(d, "") for d in out])), [r for r in held if r[0] not in out]
    assert kept(index, frame(held)) == brute(held)
    counts = {}
    for _, text in held:
        for line in text.split("\n"):
            if len(key_of(line)) >= 10:
                counts[key_of(line)] = counts.get(key_of(line), 0) + 1
    assert sorted(r.n_lines for r in line_dedup.references(index).collect()) == sorted(counts.values())
    # every key that is left has its entry, and nothing else has one
    entries = sum(int((cuckoo.load(bytes(r.tables)) != 0).sum()) for r in index.filters.collect())
    assert entries == len(counts)
    nothing = line_dedup.delete(index, frame(held))
    assert sum(int((cuckoo.load(bytes(r.tables)) != 0).sum()) for r in nothing.filters.collect()) == 0
    again = line_dedup.insert(nothing, frame(held))
    assert kept(again, frame(held)) == brute(held)


def test_very_long_text(spark):
    lines = [f"line number {i % 30_000}" for i in range(60_000)]
    rows = [(1, "\n".join(lines[:100])), (2, "\n".join(lines)), (3, "y" * 2_000_000)]
    docs = spark.createDataFrame(rows, SCHEMA)
    assert kept(line_dedup.new_index(docs), docs) == brute(rows)


@pytest.mark.parametrize("n", [10, 3_000, 60_000])
def test_cuckoo_filter(n):
    rng = np.random.default_rng(n)
    h1, h2 = (rng.integers(-(2**63), 2**63, n, dtype=np.int64) for _ in range(2))
    tables = cuckoo.insert(cuckoo.load(None), *cuckoo.places(h1[: n // 2], h2[: n // 2]))
    tables = cuckoo.insert(tables, *cuckoo.places(h1[n // 2 :], h2[n // 2 :]))
    assert (tables != 0).sum() == n and cuckoo.contains(tables, *cuckoo.places(h1, h2)).all()
    odd = np.arange(n) % 2 == 1
    assert cuckoo.delete(tables, *cuckoo.places(h1[odd], h2[odd])) == 0
    assert cuckoo.contains(tables, *cuckoo.places(h1[~odd], h2[~odd])).all()
    assert cuckoo.contains(tables, *cuckoo.places(h1[odd], h2[odd])).mean() < 0.02 + 0.001 * len(tables)
    assert cuckoo.delete(tables, *cuckoo.places(h1[~odd], h2[~odd])) == 0 and not tables.any()
    equal = cuckoo.places(np.full(9, 5), np.full(9, 7))  # more copies than two buckets hold
    assert cuckoo.delete(cuckoo.insert(tables, *equal), *equal) == 0


def test_query_keeps_whole_texts(spark):
    sf = "/root/testdata/sf0.001"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    want = [(d, n, g, hashlib.sha256(t.encode()).hexdigest()) for d, n, g, t in brute(docs)]
    got = op11_line_dedup(spark, sf)
    assert sorted(map(tuple, got.select("doc_id", "n_lines", "n_dropped", "kept_sha256").collect())) == sorted(want)
