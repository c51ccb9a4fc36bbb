import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.llm import negatives

SCHEMA = "vec_id long, embedding array<double>, label int"


def brute(rows, every=5):
    good = [(i, [math.floor(256 * x) for x in e], l) for i, e, l in rows if i is not None and l is not None and e is not None and all(x is not None and math.isfinite(x) for x in e)]
    out = set()
    for a, e, l in good:
        if a % every:
            continue
        scored = sorted((-sum(x * y for x, y in zip(e, f)), i, m == l) for i, f, m in good if i != a)
        for p, pos, _ in [s for s in scored if s[2]][:5]:
            fit = [(n, neg) for n, neg, same in scored if not same and 30 * -p <= 100 * -n <= 90 * -p][:10]
            out |= {(a, pos, r + 1, neg, -p, -n) for r, (n, neg) in enumerate(fit)}
    return sorted(out)


def found(df, every=5):
    out = negatives.hard_negatives(negatives.prepare(df, F.col("label")), F.col("vec_id") % every == 0)
    return sorted(set(map(tuple, out.collect())))


def make(rng, n, dims=6):
    rows = []
    for i in range(n):
        size = rng.choice([0.1, 1.0, 1.0, 3.0])
        rows.append((i, [round(rng.gauss(0.5, 1) * size, 1) for _ in range(dims)], rng.randrange(3)))
    return rows


@pytest.mark.parametrize("sample", [4, 4096])
def test_against_brute_force(spark, monkeypatch, sample):
    monkeypatch.setattr(negatives, "SAMPLE", sample)  # few: more rounds
    monkeypatch.setattr(negatives, "ROWS", 37)
    monkeypatch.setattr(negatives, "ANCHORS", 7)
    rng = random.Random(sample)
    rows = make(rng, 220)
    rows += [(1000 + i, rows[i][1], rows[i][2]) for i in range(20)] + rows[:3]  # ties and repeated rows
    rows += [(None, [1.0] * 6, 1), (7000, None, 1), (7001, [1.0, None], 0), (7002, [float("nan")] * 6, 0), (7005, [float("inf")] * 6, 0), (7010, [1.0] * 6, None)]
    rows += [(7015, [2.0, 1.0], 1), (7020, [], 2), (7025, [0.0] * 6, 0)]
    assert found(spark.createDataFrame(rows, SCHEMA)) == brute(rows)


def test_empty_lonely_and_clashing_columns(spark):
    assert found(spark.createDataFrame([], SCHEMA)) == []
    lonely = [(0, [1.0, 2.0], 0), (1, [1.0, 1.5], 1)]
    assert found(spark.createDataFrame(lonely, SCHEMA)) == brute(lonely) == []
    rows = make(random.Random(1), 30)
    wide = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as key", "2 as v", "3 as score", "4 as rank", "5 as w")
    assert found(wide) == brute(rows)
    with pytest.raises(ValueError):
        found(spark.createDataFrame([(0, [1e9, 1.0], 0)], SCHEMA))


def test_candidates_are_exact(monkeypatch):
    monkeypatch.setattr(negatives, "CHUNK", 3)
    rng = np.random.default_rng(2)
    scale = rng.choice([1, 30, 900], 200)[:, None]
    x, q = np.floor(rng.normal(0, 1, (200, 16)) * scale), np.floor(rng.normal(0, 300, (25, 16)))
    x[:, 9:] = np.floor(x[:, 9:] / 50)  # suffixes that the index leaves out
    every = q @ x.T
    for lowest in (np.full(25, -np.inf), np.quantile(every, 0.97, axis=1), np.full(25, every.max()), np.full(25, 1e12)):
        i, j, score = negatives.candidates(q, lowest, x)
        want = {(a, b, every[a, b]) for a, b in zip(*np.nonzero(every >= lowest[:, None]))}
        assert set(zip(i, j, score)) == want and len(i) == len(want)
