import random
import re

import numpy as np
import pytest

from plumbline.llm import jaccard
from plumbline.llm.components import connected_components

SCHEMA = "doc_id long, text string, component_id string, n string"


def shingles(text, width):
    w = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    return frozenset(tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))) if w else frozenset()


def brute(docs, width, a, b):
    sets = [shingles(t, width) for _, t in docs]
    label = list(range(len(docs)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(docs)):
        for j in range(i):
            x, y = sets[i], sets[j]
            if x and y and b * len(x & y) >= a * len(x | y):
                label[root(i)] = root(j)
    best = {}
    for i, (d, _) in enumerate(docs):
        best.setdefault(root(i), []).append(d)
    least = {r: min((x for x in v if x is not None), default=None) for r, v in best.items()}
    return sorted(((d, len(sets[i]), least[root(i)]) for i, (d, _) in enumerate(docs)), key=str)


def run(spark, docs, width=3, similarity=(90, 100)):
    frame = spark.createDataFrame([(d, t, "x", "y") for d, t in docs], SCHEMA).repartition(3)
    return sorted([tuple(r) for r in jaccard.similar_documents(frame, width, similarity).select("doc_id", "n_shingles", "component_id").collect()], key=str)


def corpus(seed, n=260):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(300)]
    docs = []
    for d in range(n):
        if docs and rng.random() < 0.7:
            w = (rng.choice(docs[-40:])[1] or "x y z").split()
            for _ in range(rng.choice([0, 1, 1, 2, 4, 8])):
                k = rng.randrange(len(w))
                w[k : k + rng.choice([0, 1, 1])] = [rng.choice(vocabulary)]
            docs.append((d, " ".join(w)))
        else:
            docs.append((d, " ".join(rng.choices(vocabulary, k=rng.choice([1, 2, 3, 4, 12, 40, 90, 200])))))
    return docs


def test_components_equal_brute_force(spark):
    docs = corpus(1) + [(900, None), (901, ""), (902, " \n"), (903, "One two"), (904, "one TWO"), (3, "one two"), (None, "one two three"), (None, "one two three"), (905, "one  two\tthree")]
    assert run(spark, docs) == brute(docs, 3, 90, 100)


def test_other_width_and_similarity(spark):
    docs = corpus(2, 200)
    assert run(spark, docs, 5, (80, 100)) == brute(docs, 5, 80, 100)


def test_a_large_group_of_near_copies_is_tiled(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "TILE", 16)
    rng = random.Random(4)
    base = [f"b{i}" for i in range(150)]
    docs = []
    for d in range(220):
        w = list(base)
        for _ in range(rng.randint(2, 9)):
            w[rng.randrange(len(w))] = f"x{rng.randrange(50)}"
        docs.append((d, " ".join(w)))
    docs += [(1000 + i, docs[0][1]) for i in range(60)]
    assert run(spark, docs) == brute(docs, 3, 90, 100)


def test_no_rows(spark):
    assert run(spark, []) == []


def test_hamming_distance_of_sketches_bounds_the_difference():
    from plumbline.llm.texts import words_of, as_text
    import pyarrow as pa

    bands = jaccard.Bands(90, 100)
    docs = [t for _, t in corpus(3, 80)]
    row, hashes, size = jaccard.distinct_shingles(words_of(as_text(pa.array(docs))), 3)
    band = np.full(len(docs), 12)
    _, fold = jaccard.sketches(row, hashes, band, size > 0, bands)
    matrix = jaccard.fold_matrix(fold)
    sets = [shingles(t, 3) for t in docs]
    for i in range(80):
        for j in range(i):
            assert np.bitwise_count(matrix[i] ^ matrix[j]).sum() <= len(sets[i] ^ sets[j])


def test_components_of_chains_stars_and_loops(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(7, 7), (200, 201), (201, 200), (None, 3)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{100 + i: 100 for i in range(30)}, 200: 200, 201: 200}
    assert connected_components(spark.createDataFrame([], "u long, v long")).count() == 0
    with pytest.raises(Exception):
        connected_components(spark.createDataFrame([], "a long"))


def test_a_forest_spans_what_the_pairs_join():
    rng = np.random.default_rng(5)
    for size, count in ((1, 0), (12, 9), (40, 300)):
        u, v = rng.integers(0, size, (2, count))
        label = np.unique(rng.integers(0, size, size), return_inverse=True)[1]
        weight = rng.integers(0, 5, count)
        kept = jaccard.spanning(u, v, weight, label)
        parts = lambda at: connected(label[u[at]], label[v[at]], label)  # noqa: B023, E731
        assert len(kept) == len(set(parts([]))) - len(set(parts(kept))) and parts(kept) == parts(range(count))


def connected(a, b, label):
    root = list(range(max(label) + 1))
    for x, y in list(zip(a, b)) * len(root):
        root[x] = root[y] = min(root[x], root[y])
    return root


def test_near_copies_give_no_more_pairs_than_members(spark, monkeypatch):
    made = []
    plain = jaccard.tile_pairs

    def counted(*args):
        out = plain(*args)
        made.append(out.count())
        return out

    monkeypatch.setattr(jaccard, "tile_pairs", counted)
    rng = random.Random(6)
    base = [f"b{i}" for i in range(200)]
    docs = []
    for d in range(300):
        w = list(base)
        for _ in range(2):
            w[rng.randrange(len(w))] = f"x{rng.randrange(50)}"
        docs.append((d, " ".join(w)))
    docs = [(d, t if d % 2 else t + " " + " ".join(f"z{i}" for i in range(5))) for d, t in docs]
    assert run(spark, docs) == brute(docs, 3, 90, 100)
    assert sum(made) <= 2 * len(docs)


def part_keys(sets, bands):
    """The keys of each of ``sets`` (arrays of hashes), own and next band's together."""
    row, hashes = np.repeat(np.arange(len(sets)), [len(x) for x in sets]), np.concatenate([np.sort(x) for x in sets])
    own, up = jaccard.both_sketches(row, hashes, np.bincount(row), bands)
    return [set(a or []) | set(b or []) for a, b in zip(own[0].to_pylist(), up[0].to_pylist())]


@pytest.mark.parametrize("a", [80, 90])
def test_similar_sets_share_a_part_and_others_do_not(a):
    bands = jaccard.Bands(a, 100)
    rng = np.random.default_rng(a)
    sets = []
    for n in [*range(2, 60), *rng.integers(60, 700, 240)]:
        x = rng.integers(0, 1 << 64, n, dtype=np.uint64)
        out = int(rng.integers(0, (100 - a) * n // 100 + 1))  # |x & y| / |x | y| >= a / 100 if so many are taken out or replaced as that allows
        put = int((100 * (n - out) // a) - n) if out else int(100 * n // a - n)
        sets += [x, np.concatenate([x[out:], rng.integers(0, 1 << 64, max(0, put), dtype=np.uint64)])]
    keys = part_keys(sets, bands)
    for i in range(0, len(sets), 2):
        both = len(np.intersect1d(sets[i], sets[i + 1]))
        assert 100 * both >= a * (len(sets[i]) + len(sets[i + 1]) - both)
        assert keys[i] & keys[i + 1]
    met = sum(bool(keys[i] & keys[j]) for i in range(0, len(sets), 2) for j in range(0, i, 2))
    assert met <= 3  # words of 64 bits and empty parts brought hundreds of unrelated pairs together


def test_settled_buckets_are_not_compared_again(spark, monkeypatch):
    given = []
    plain = jaccard.tile_pairs

    def counted(members, *args):
        given.append(members.count())
        return plain(members, *args)

    monkeypatch.setattr(jaccard, "tile_pairs", counted)
    rng = random.Random(7)
    docs = []
    for d in range(120):  # three documents have a half in common: they share parts, but no two are similar
        half = [f"h{d // 3}-{i}" for i in range(60)]
        docs.append((d, " ".join(half + [f"o{d}-{i}" for i in range(40)])))
    docs.append((500, docs[0][1].rsplit(" ", 1)[0]))
    assert run(spark, docs, 5, (80, 100)) == brute(docs, 5, 80, 100)
    assert given[0] > 0 and given[1:] == [0, 0]
