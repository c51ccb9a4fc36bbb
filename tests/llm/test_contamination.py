import random
import re

from plumbline.llm import contamination as c

SCHEMA = "doc_id long, text string, item_id string, containment string"


def shingles(text, width):
    w = [x.decode() for x in re.findall(rb"[^\x20\x09-\x0D]+", bytes((text or "").encode()).lower())]
    return {tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set(), len(w)


def brute(docs, items, width=5, threshold=0.8):
    out = []
    for d, t in docs:
        for i, q in items:
            wanted, n = shingles(q, width)
            if wanted:
                found = len(wanted & shingles(t, min(width, n))[0])
                if found and found >= threshold * len(wanted) - 1e-9:
                    out.append((d, i, len(wanted), found))
    return sorted(out, key=str)


def run(spark, docs, items):
    frame = spark.createDataFrame([(d, t, "x", "y") for d, t in docs], SCHEMA).repartition(3)
    bench = spark.createDataFrame(items, "item_id long, text string")
    return sorted([(r.doc_id, r.item_id, r.n_shingles, r.n_found) for r in c.find_items(frame, bench).collect()], key=str)


def test_pairs_equal_brute_force(spark):
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(60)]
    say = lambda n: " ".join(rng.choices(vocabulary, k=n))
    items = [(i, say(rng.choice([1, 2, 3, 4, 5, 6, 14, 30, 59]))) for i in range(30)] + [(30, None), (31, " \n"), (32, "only Four WORDS here"), (33, "only four words Here")]
    docs = [(100, None), (101, ""), (None, items[5][1]), (103, items[7][1]), (103, items[7][1])]
    for d in range(120):
        parts = [say(rng.randint(0, 40))]
        for _ in range(rng.randint(0, 2)):
            w = items[rng.randrange(30)][1].split()
            for _ in range(rng.choice([0, 0, 1, 2])):
                w[rng.randrange(len(w))] = rng.choice(vocabulary)
            parts += [" ".join(w).upper(), say(rng.randint(0, 30))]
        docs.append((d, "\n".join(parts)))
    docs.append((200, say(30000) + " " + items[12][1] + "  only\tfour words here " + say(20000)))
    got = run(spark, docs, items)
    assert got == brute(docs, items) and len(got) > 50


def test_empty_tables(spark):
    assert run(spark, [], [(1, "a b c d e f")]) == []
    assert run(spark, [(1, "a b c d e f")], []) == []


def test_sketch_lengths_cover_the_threshold():
    for n in range(1, 300):
        low, high = c.size_class(n)
        assert low <= n <= high
        missable = n - next(m for m in range(n + 1) if m >= 0.8 * n - 1e-9)
        assert c.sketch_length(high) > missable
