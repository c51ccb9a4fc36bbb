import math

import numpy as np
import pyarrow as pa
import pytest

from plumbline.llm import metric_join

SCHEMA = "vec_id long, embedding array<float>, n_links string, v string"


def brute(rows, cosine=0.95):
    def fine(v):
        return bool(v) and all(x is not None and math.isfinite(x) for x in v) and any(v)

    n = len(rows)
    unit = [np.array(v, np.float32).astype(float) / np.linalg.norm(np.array(v, np.float32).astype(float)) if fine(v) else None for _, v in rows]
    links = [[j for j in range(n) if j != i and unit[i] is not None and unit[j] is not None and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= cosine] for i in range(n)]
    out = []
    for i in range(n):
        seen, todo = {i}, [i]
        while todo:
            for j in links[todo.pop()]:
                if j not in seen:
                    seen.add(j), todo.append(j)
        least = min((rows[j][0] for j in seen if rows[j][0] is not None), default=None)
        out.append((rows[i][0], len(links[i]), least, rows[i][0] == least))
    return sorted(out, key=str)


def run(spark, rows, **options):
    frame = spark.createDataFrame([(i, v, "x", "y") for i, v in rows], SCHEMA).repartition(3)
    return sorted([tuple(r) for r in metric_join.near_vectors(frame, **options).select("vec_id", "n_links", "component_id", "kept").collect()], key=str)


@pytest.mark.parametrize("dims, cell, tiles", [(6, 20, (16, 24)), (3, 400, (2048, 8192)), (16, 60, (8, 500))])
def test_links_equal_brute_force(spark, monkeypatch, dims, cell, tiles):
    monkeypatch.setattr(metric_join, "HOME_TILE", tiles[0])
    monkeypatch.setattr(metric_join, "ALL_TILE", tiles[1])
    rng = np.random.default_rng(dims)
    base = rng.normal(size=(60, dims))
    rows = []
    for i in range(260):
        x = base[rng.integers(60)] * rng.uniform(0.5, 2) + rng.normal(size=dims) * rng.choice([0, 0.1, 0.3])
        rows.append((i, [float(np.float32(v)) for v in x]))
    rows += [(500 + i, rows[3][1]) for i in range(20)]
    rows += [(600, None), (601, []), (602, [0.0] * dims), (603, [float("nan")] * dims), (604, [float("inf")] + [1.0] * (dims - 1)), (605, [None] + [1.0] * (dims - 1)), (606, [1.0, 2.0]), (607, [1.0, 2.0]), (None, rows[5][1]), (5, rows[5][1])]
    assert run(spark, rows, cell=cell) == brute(rows)


def test_large_and_tiny_components_and_the_threshold(spark):
    rows = [(1, [1e30, 0.0]), (2, [1e-30, 0.0]), (3, [0.0, 1.0]), (4, [3.0, 4.0]), (5, [4.0, 3.0])]
    assert run(spark, rows, cosine=0.96) == brute(rows, 0.96)
    assert run(spark, rows, cosine=0.9601) == brute(rows, 0.9601)


def test_no_rows(spark):
    assert run(spark, []) == []
    assert run(spark, [(1, None)]) == [(1, 0, 1, True)]


def test_scaled_copies_reach_every_cell_of_equal_pivots():
    rng = np.random.default_rng(5)
    reach = float(np.sqrt(2 - 2 * 0.95))
    for _ in range(200):
        one = rng.normal(size=64)
        copies = one[None, :] * rng.uniform(0.1, 10, 300)[:, None]
        copies = metric_join.unit_rows(pa.array(copies.tolist(), pa.list_(pa.float64())))
        other = metric_join.unit_rows(pa.array(rng.normal(size=(5, 64)).tolist(), pa.list_(pa.float64())))
        pivots = np.concatenate([copies[:2], other])
        home, distance, _ = metric_join.cells_of(copies, pivots, None, reach)
        radius = np.full(len(pivots), -10.0)
        np.maximum.at(radius, home, distance)
        _, _, inside = metric_join.cells_of(copies, pivots, radius, reach)
        assert inside[:, np.unique(home)].all()  # all are linked, so each cell with a home vector needs all
