"""Near-duplicate vectors by an exact metric range join.

Unit vectors with cosine >= t are at most r = sqrt(2 - 2t) apart. Pivots cut the space into cells: a vector's home
is its nearest pivot. If y has home j and d(x, y) <= r, the triangle inequality gives d(x, p_j) <= d(x, p_i) + 2r
for the home i of x, and, the boundary of two cells being the plane between their pivots, x lies at most r beyond
it: (d(x, p_j)^2 - d(x, p_i)^2) / (2 d(p_i, p_j)) <= r. x is copied to exactly the cells that pass both and the
largest home distance of the cell plus r. A cell then holds every partner of its home vectors and is joined on
its own, in tiles of bounded size.

Equal vectors are one node with a weight. A tile sends back a link count per home vector and, instead of its pairs,
edges from linked vectors to one representative of each group that hangs together in the tile.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.storage import materialise
from .components import connected_components

COSINE = 0.95
#: Vectors a cell is meant for, and the most pivots (they travel with the tasks).
CELL = 8192
MAX_PIVOTS = 1024
#: Home vectors and all vectors of a tile.
HOME_TILE, ALL_TILE = 2048, 8192
_BLOCK = 512


def unit_rows(column: pa.Array) -> np.ndarray:
    """A list column of equally long vectors as unit rows in double precision."""
    x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)
    x = x / np.maximum(np.abs(x).max(axis=1, keepdims=True), 1e-300)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def cells_of(x: np.ndarray, pivots: np.ndarray, radius: np.ndarray | None, reach: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(home, distance to its pivot, boolean matrix of the cells each vector belongs to)."""
    squared = np.maximum(2 - 2 * (x @ pivots.T), 0)
    home = squared.argmin(axis=1)
    own = squared[np.arange(len(x)), home]
    if radius is None:
        return home, np.sqrt(own), np.zeros((0, 0), bool)
    apart = np.sqrt(np.maximum(2 - 2 * (pivots @ pivots.T), 0))[home]
    slack = 1e-7
    inside = squared - own[:, None] <= 2 * apart * (reach + slack) + 1e-9
    inside |= apart < 1e-5  # rounding leaves no plane between such pivots
    distance = np.sqrt(squared)
    inside &= distance <= np.sqrt(own)[:, None] + 2 * reach + slack
    inside &= distance <= radius + reach + slack
    inside[np.arange(len(x)), home] = True
    return home, np.sqrt(own), inside


def linked_mask(home: np.ndarray, others: np.ndarray, cosine: float) -> np.ndarray:
    """Boolean matrix of cosine >= ``cosine``: single precision decides clear cases, double precision the rest."""
    out = np.zeros((len(home), len(others)), bool)
    margin = 1e-5 + 1e-6 * home.shape[1] ** 0.5
    small, small_others = home.astype(np.float32), others.astype(np.float32).T
    for i in range(0, len(home), _BLOCK):
        near = small[i : i + _BLOCK] @ small_others
        block = near >= cosine
        a, b = np.nonzero(np.abs(near - cosine) <= margin)
        block[a, b] = np.einsum("ij,ij->i", home[i + a], others[b]) >= cosine
        out[i : i + _BLOCK] = block
    return out


def hang_together(mask: np.ndarray, home: np.ndarray, others: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Smallest node reachable in the tile, for home rows and for other columns."""
    top, side = home.copy(), others.copy()
    big = np.iinfo(np.int64).max
    while True:
        for i in range(0, len(top), _BLOCK):
            top[i : i + _BLOCK] = np.minimum(top[i : i + _BLOCK], np.where(mask[i : i + _BLOCK], side, big).min(axis=1))
        new = side.copy()
        for i in range(0, len(top), _BLOCK):
            new = np.minimum(new, np.where(mask[i : i + _BLOCK], top[i : i + _BLOCK, None], big).min(axis=0))
        if (new == side).all():
            return top, side
        side = new


def near_vectors(vectors: DataFrame, cosine: float = COSINE, id_column: str = "vec_id", vector_column: str = "embedding", cell: int = CELL) -> DataFrame:
    """(id, n_links, component_id, kept) of every row of ``vectors``.

    n_links counts the other rows with cosine >= ``cosine`` (in double precision), component_id is the smallest id
    reachable over links, kept says whether the row is that one. Null or empty vectors, zero vectors and those with
    null, NaN or infinite components link with nothing; vectors of different lengths do not link. Repeated ids
    and rows stay separate rows; rows with a null id link like others, and such an id counts only where a
    component has no other. Other columns are not read. An empty table gives an empty result.
    """
    rows = vectors.select(F.col(id_column).alias("id"), F.col(vector_column).alias("v"))
    fine = F.col("v").isNotNull() & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    rows = rows.withColumn("v", F.when(fine, F.col("v")))
    one = rows.where("v is not null").groupBy("v").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("copies"))
    nodes = materialise(one.withColumns({"node": F.monotonically_increasing_id(), "size": F.size("v")}), "vectors")

    found = None
    for size, n in nodes.groupBy("size").count().orderBy("size").collect():  # one row per vector length
        part = links_of(nodes.where(F.col("size") == size), n, cosine, cell)
        found = part if found is None else found.union(part)
    if found is None:
        found = vectors.sparkSession.createDataFrame([], "u long, v long, links long")
    found = materialise(found, "vector-links")
    links = found.groupBy(F.col("u").alias("node")).agg(F.sum("links").alias("links"))
    labels = connected_components(found.select("u", "v"))
    named = labels.join(nodes.select("node", "id"), "node").groupBy("component").agg(F.min("id").alias("component_id"))
    known = nodes.join(links, "node", "left").join(labels, "node", "left").join(named, "component", "left")
    known = known.select("v", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component_id", "id").alias("component_id"))
    out = rows.join(known, "v", "left").select("id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.when(F.col("v").isNull(), F.col("id")).otherwise(F.col("component_id")).alias("component_id"))
    return out.withColumn("kept", F.col("id").eqNullSafe(F.col("component_id"))).withColumnRenamed("id", id_column)


def links_of(nodes: DataFrame, n: int, cosine: float, cell: int) -> DataFrame:
    """(u, v, links): link counts of nodes and edges that keep their components, for vectors of one length."""
    reach = float(np.sqrt(max(0.0, 2 - 2 * cosine)))
    wanted = min(MAX_PIVOTS, -(-n // cell))
    chosen = nodes.orderBy(F.xxhash64("v"), "node").limit(wanted).select("v").toArrow()
    pivots = unit_rows(chosen.column("v").combine_chunks())

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            home, distance, _ = cells_of(unit_rows(batch.column(0)), pivots, None, reach)
            yield pa.RecordBatch.from_pydict({"cell": home.astype(np.int32), "d": distance})

    radius = np.full(len(pivots), -10.0)
    homes = np.zeros(len(pivots), np.int64)
    for c, d, k in nodes.select("v").mapInArrow(measure, "cell int, d double").groupBy("cell").agg(F.max("d"), F.count(F.lit(1))).collect():
        radius[c], homes[c] = d, k

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            home, _, inside = cells_of(unit_rows(batch.column("v")), pivots, radius, reach)
            row, to = np.nonzero(inside)
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(pa.array(row)) for c in ("node", "copies", "v")), pa.array(to.astype(np.int32)), pa.array(home[row] == to)], ["node", "copies", "v", "cell", "home"])

    kind = nodes.schema["v"].dataType.simpleString()
    dealt = materialise(nodes.select("node", "copies", "v").mapInArrow(deal, f"node long, copies long, v {kind}, cell int, home boolean"), "cells")
    counts = dealt.groupBy("cell").agg(F.ceil(F.count_if("home") / HOME_TILE).cast("int").alias("rows"), F.ceil(F.count(F.lit(1)) / ALL_TILE).cast("int").alias("columns"))
    placed = dealt.join(F.broadcast(counts), "cell")  # a row per pivot, at most MAX_PIVOTS
    mixed = F.xxhash64("node")
    across = F.explode(F.sequence(F.lit(0), F.col("columns") - 1))
    down = F.explode(F.sequence(F.lit(0), F.col("rows") - 1))
    as_home = placed.where("home").select("cell", F.pmod(mixed, "rows").cast("int").alias("a"), across.alias("b"), F.lit(True).alias("top"), "node", "copies", "v")
    as_other = placed.where("rows > 0").select("cell", down.alias("a"), F.pmod(mixed, "columns").cast("int").alias("b"), F.lit(False).alias("top"), "node", "copies", "v")

    def compare(t: pa.Table) -> pa.Table:
        top = t.column("top").to_numpy()
        node, copies = t.column("node").to_numpy(), t.column("copies").to_numpy()
        x = unit_rows(t.column("v").combine_chunks())
        home, others = np.flatnonzero(top), np.flatnonzero(~top)
        mask = linked_mask(x[home], x[others], cosine)
        place = {k: i for i, k in enumerate(node[others].tolist())}
        own = [(i, place[k]) for i, k in enumerate(node[home].tolist()) if k in place]
        for i, j in own:
            mask[i, j] = False
        rows, columns = mask.any(axis=1), mask.any(axis=0)
        home, others, mask = home[rows], others[columns], mask[rows][:, columns]
        if not len(home):
            return pa.table({"u": pa.array([], pa.int64()), "v": pa.array([], pa.int64()), "links": pa.array([], pa.int64())})
        links = np.array([copies[others][m].sum() for m in mask])
        a, b = hang_together(mask, node[home], node[others])
        return pa.table({"u": np.concatenate([node[home], node[others]]), "v": np.concatenate([a, b]), "links": np.concatenate([links, np.zeros(len(others), np.int64)])})

    return as_home.union(as_other).groupBy("cell", "a", "b").applyInArrow(compare, "u long, v long, links long")
