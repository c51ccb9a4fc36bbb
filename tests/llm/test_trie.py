import hashlib
import random
import re
import zlib

from plumbline.llm import trie

SCHEMA = "conv_id long, turn long, role string, text string"


def brute(rows):
    convs = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            convs.setdefault(conv, []).append(((turn is not None, turn or 0), role or "", text or ""))
    whole = {c: [(r, t) for _, r, t in sorted(turns)] for c, turns in convs.items()}
    rebuilt = {}
    for c, turns in whole.items():
        h = zlib.crc32(str(c).encode()) % 4
        rebuilt[c] = whole.get(c - c % 20, [])[:h] + turns[h:]
    members, ends = {}, {}
    for c, turns in rebuilt.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
        ends.setdefault(tuple(turns), []).append(c)
    children, leaves, saved = {}, {}, {}
    for p in members:
        if p:
            children[p[:-1]] = children.get(p[:-1], 0) + 1
    for p in members:
        own = (len(members[p]) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0
        for d in range(len(p) + 1):
            leaves[p[:d]] = leaves.get(p[:d], 0) + (p not in children)
            saved[p[:d]] = saved.get(p[:d], 0) + own
    sha = lambda p: hashlib.sha256(",".join(map(str, sorted(ends.get(p, [])))).encode()).hexdigest()
    return sorted(
        ((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), children.get(p, 0), leaves[p], saved[p], sha(p)) for p, m in members.items()), key=str
    )


def found(df):
    columns = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
    return sorted(map(tuple, trie.prefix_trie(df).select(*columns).collect()), key=str)


def test_random_conversations_with_ties_and_nulls(spark):
    rng = random.Random(7)
    rows = []
    for c in [*range(70), 120, 125, 141]:
        for t in range(rng.randrange(1, 7)):
            rows.append((c, rng.choice([t, t, t, 0, None]), rng.choice(["user", "user", None]), rng.choice(["a b", "a  b c\n", "", None, "é  x"])))
    rows += rng.choices(rows, k=40) + [(None, 1, "user", "of nobody")] * 3
    assert found(spark.createDataFrame(rows, SCHEMA)) == brute(rows)


def test_long_chain_and_large_group(spark, monkeypatch):
    monkeypatch.setattr(trie, "IDS_PER_CHUNK", 100)
    monkeypatch.setattr(trie, "STEP", 16)
    rows = [(c, 0, "user", "the same words") for c in range(2, 700)]  # copies
    rows += [(20_000, t, "user", f"turn {t}") for t in range(90)] + [(20_001, t, "user", f"turn {t}") for t in range(85)]
    rows += [(20_040, None, "user", "again")] * 70 + [(20_041, 1, "user", "x" * 300_000 + " y"), (20_045, 1, "user", "x" * 300_000 + " y")]
    assert found(spark.createDataFrame(rows, SCHEMA)) == brute(rows)


def test_empty_table_and_clashing_columns(spark):
    assert found(spark.createDataFrame([], SCHEMA)) == []
    rows = [(1, 0, "user", "hello there"), (2, 0, "user", "hello there")]
    wide = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as node", "2 as depth", "'x' as k", "3 as n_turns", "4 as words", "5 as h1")
    assert found(wide) == brute(rows)


def test_contraction_of_odd_trees(spark):
    rng = random.Random(3)
    parents = {0: None}
    for i in range(1, 300):  # a chain with a broom at its end, and random nodes
        parents[i] = i - 1 if i < 130 else 129 if i < 170 else rng.randrange(i)
    parents |= {1000: None, 1001: 1000}
    value = {i: rng.randrange(100) for i in parents}
    want = dict(value)
    for i in sorted(parents, reverse=True):
        if parents[i] is not None:
            want[parents[i]] += want[i]
    pair = lambda i: None if i is None else (i, -i)
    tree = spark.createDataFrame([(pair(i), pair(p), value[i]) for i, p in parents.items()], "node struct<a:long,b:long>, parent struct<a:long,b:long>, v long")
    assert {r.node.a: r.v for r in trie.subtree_totals(tree, ["v"]).collect()} == want
