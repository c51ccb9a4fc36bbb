"""Documents whose shingle sets are similar: a parity-sketch join.

A set of n shingles is dealt into b parts; in its sketch each shingle flips one bit of its part's word of 64 bits. The
Hamming distance of two sketches never exceeds the symmetric difference of the sets, and sets with Jaccard
similarity >= t differ in at most d = (1 - t) / (1 + t) * (|A| + |B|) shingles. Sizes fall into bands; in a band
whose largest size is m a set has more than d(m) parts, so two similar sets agree in at least one whole part
(pigeonhole) and meet in a join on (band, part number, XOR of the part's whole hashes). Parts without a shingle are equal in
many sets, so they are a key only for a set with so many of them that a similar one may agree with it in no other; a few parts
more than d(m) + 1 make that rare. A set whose size reaches the next band within the similarity also joins there.

Equal sets are one node from the start. Words shared by several nodes are then worked off in three ways that
together lose no link. Star rounds pair each bucket's pseudo-randomly chosen member with the others. Forest rounds deal
the members of a bucket that are not connected yet into parts of bounded size and keep of a part's pairs those that span it
(nearest first), so a group of near copies gives no more pairs than it has members. The tile
step compares all members that are not connected even then, in tiles of bounded size, so that a bucket
with very many members is spread over tasks. A bucket goes on to the next round only if it may hold a pair that was not compared:
two members are done with after the star, a bucket of one part is done with if all its pairs were kept. All hold the Hamming
distance of folded sketches (XOR of words, still a lower bound) against d, tiles that of coarser ones first, and only pairs that
pass become rows, whose shingle sets are then compared exactly (as 64-bit hashes). Pairs inside a component are never expanded.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.storage import materialise
from .bitmaps import bitmap_of, in_bitmap
from .components import connected_components
from .texts import as_signed, mix, sliced_words

GROWTH = 1.5
FOREST_ROUNDS = 2
#: Members of a bucket compared in one tile, on either side.
TILE = 256
#: Sketch words folded into one, and those words folded again. Unfolded sketches have about as many bits as 64 * the allowed difference.
FOLD, COARSE = 4, 4
#: One part more than the pigeonhole needs for so many of them.
SPARE = 16


class Bands:
    """Size bands and the sketch shape of each, for similarity >= a / b."""

    def __init__(self, a: int, b: int):
        self.a, self.b = a, b
        low = [1]
        while low[-1] < 1 << 34:
            low.append(max(low[-1], int(low[-1] * GROWTH)) + 1)
        self.low = np.array(low, np.int64)
        least = self.bound(2 * (self.low[1:] - 1)) + 1
        self.words = least + least // SPARE
        self.fold = self.words // FOLD + 1

    def bound(self, sizes):
        """Most shingles in which two similar sets of so many shingles together can differ."""
        return (self.b - self.a) * sizes // (self.b + self.a)

    def of(self, n: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.low, n, side="right") - 1

    def differ(self, n: np.ndarray, band: np.ndarray) -> np.ndarray:
        """Most shingles in which a set of ``n`` and a similar one can differ that meet in ``band``."""
        return self.bound(n + np.minimum(self.low[band + 1] - 1, n * self.b // self.a))

    def reaches_next(self, n: np.ndarray, band: np.ndarray) -> np.ndarray:
        return self.b * n >= self.a * self.low[band + 1]


def distinct_shingles(words, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, hash, size per row): distinct shingle hashes, sorted inside each row."""
    row, hashes = words.shingles(width)
    ends = np.cumsum(np.bincount(row, minlength=words.n_docs))
    for a, b in zip(np.concatenate([[0], ends[:-1]]).tolist(), ends.tolist()):
        hashes[a:b].sort()
    keep = np.ones(len(row), bool)
    keep[1:] = (hashes[1:] != hashes[:-1]) | (row[1:] != row[:-1])
    row, hashes = row[keep], hashes[keep]
    return row, hashes, np.bincount(row, minlength=words.n_docs)


def signatures(hashes: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits that name each row's set: two sums over its mixed hashes."""
    out = np.zeros((2, len(size)), np.uint64)
    full = size > 0
    if full.any():
        starts = (np.cumsum(size) - size)[full]
        for k, salt in enumerate((0x9FB21C651E98DF25, 0xD6E8FEB86659FD93)):
            out[k, full] = np.add.reduceat(mix(hashes ^ np.uint64(salt)), starts)
    return out[0], out[1]


def sketches(row: np.ndarray, hashes: np.ndarray, band: np.ndarray, use: np.ndarray, bands: Bands) -> tuple[pa.Array, pa.Array]:
    """(keys of parts, folded sketch) lists for the rows in ``use``, in the given band; null elsewhere."""
    words = np.where(use, bands.words[band], 0)
    base = np.cumsum(words) - words
    keep = use[row]
    size = np.bincount(row, minlength=len(words))
    row, hashes = row[keep], hashes[keep]
    total = int(words.sum())
    value, whole, empty = np.zeros(total, np.uint64), np.zeros(total, np.uint64), np.ones(total, bool)
    if len(row):
        place = base[row] + ((hashes >> np.uint64(32)) * words[row].astype(np.uint64) >> np.uint64(32)).astype(np.int64)
        starts = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))  # hashes are sorted, so places are
        value[place[starts]] = np.bitwise_xor.reduceat(np.uint64(1) << (hashes & np.uint64(63)), starts)
        whole[place[starts]] = np.bitwise_xor.reduceat(hashes, starts)
        empty[place[starts]] = False
    owner = np.repeat(np.arange(len(words)), words)
    number = np.arange(total) - base[owner]
    told = np.bincount(owner[empty], minlength=len(words)) >= words - bands.differ(size, band)  # a similar set may share empty parts only
    used = ~empty | told[owner]
    keys = mix(whole ^ mix((band[owner] << 40 | number).astype(np.uint64)))[used]
    n_keys = np.bincount(owner[used], minlength=len(words))
    folds = np.where(use, bands.fold[band], 0)
    return uint_lists(n_keys, keys, use), uint_lists(folds, folded(folds, owner, number, value), use)


def folded(folds: np.ndarray, owner: np.ndarray, number: np.ndarray, value: np.ndarray) -> np.ndarray:
    """Rows of ``folds`` words each: the XOR of a row's values by their ``number`` modulo the row's words."""
    base = np.cumsum(folds) - folds
    out = np.zeros(int(folds.sum()), np.uint64)
    np.bitwise_xor.at(out, base[owner] + number % np.maximum(folds[owner], 1), value)
    return out


def uint_lists(sizes: np.ndarray, values: np.ndarray, use: np.ndarray) -> pa.Array:
    """A list column of ``sizes`` values a row, null where ``use`` is false."""
    offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32), mask=np.concatenate([~use, [False]]))
    return pa.ListArray.from_arrays(offsets, pa.array(as_signed(values)))


def coarser(fold: pa.Array) -> pa.Array:
    """Folded sketches folded once more."""
    size = fold.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    owner = np.repeat(np.arange(len(size)), size)
    number = np.arange(len(owner)) - (np.cumsum(size) - size)[owner]
    use = size > 0
    folds = np.where(use, size // COARSE + 1, 0)
    return uint_lists(folds, folded(folds, owner, number, fold.flatten().to_numpy(zero_copy_only=False).view(np.uint64)), use)


def set_table(docs: DataFrame, width: int, bands: Bands) -> DataFrame:
    """(id, row, n, band, s1, s2, keys, fold, coarse, up_keys, up_fold, up_coarse) of every row: size, band, name, keys of parts and folded
    sketches of its set, in its own band and (``up``) in the next. ``row`` is unique in one run, so the table has to be written."""
    kind = docs.schema["id"].dataType.simpleString()
    lists = [up + c for up in ("", "up_") for c in ("keys", "fold", "coarse")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 40
        for batch in batches:
            for start, stop, words in sliced_words(batch.column(1)):
                row, hashes, size = distinct_shingles(words, width)
                s1, s2 = signatures(hashes, size)
                own, up = both_sketches(row, hashes, size, bands)
                named = pa.array(np.arange(number, number + stop - start, dtype=np.int64))
                number += stop - start
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, stop - start), named, pa.array(size.astype(np.int64)), pa.array(bands.of(np.maximum(size, 1)).astype(np.int32)), pa.array(as_signed(s1)), pa.array(as_signed(s2)), *own, coarser(own[1]), *up, coarser(up[1])], ["id", "row", "n", "band", "s1", "s2", *lists])

    return docs.mapInArrow(run, f"id {kind}, row long, n long, band int, s1 long, s2 long, " + ", ".join(f"{c} array<long>" for c in lists))


def bucket_table(nodes: DataFrame) -> DataFrame:
    """(key, node, up, rows) of the parts that ``rows`` of ``nodes`` (node, keys, up_keys) share; of parts with the same nodes, one.

    Copies are one node, so a part's rows are different sets. A member is a node and, as its last bit, ``up``.
    """
    own = nodes.select(F.explode("keys").alias("key"), F.shiftleft("node", 1).alias("member"))
    words = own.union(nodes.select(F.explode("up_keys"), F.shiftleft("node", 1) + 1))
    here = Window.partitionBy("key")
    total = F.try_sum(F.shiftright(F.xxhash64("member"), 16)).over(here)
    shared = words.withColumns({"low": F.min("member").over(here), "high": F.max("member").over(here), "rows": F.count(F.lit(1)).over(here), "sum": F.coalesce(total, "key")}).where("low < high")
    name = F.when(F.col("member") == F.col("low"), F.struct("low", "high", "rows", "sum")).alias("name")
    shared = materialise(shared.select("key", "member", "rows", name), "shared-words")
    first = shared.where("name is not null").groupBy("name").agg(F.min("key").alias("key")).select("key")
    return shared.join(first, "key", "left_semi").select("key", F.shiftright("member", 1).alias("node"), (F.col("member") % 2 != 0).alias("up"), "rows")


def both_sketches(row: np.ndarray, hashes: np.ndarray, size: np.ndarray, bands: Bands):
    """Sketches in the own band of each row and, where its size reaches it, in the next."""
    band = bands.of(np.maximum(size, 1))
    own = sketches(row, hashes, band, size > 0, bands)
    return own, sketches(row, hashes, band + 1, (size > 0) & bands.reaches_next(size, band), bands)


def fold_matrix(column: pa.Array) -> np.ndarray:
    """A list column as a matrix, short rows filled up with zeros."""
    size = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    out = np.zeros((len(size), max(1, size.max(initial=1))), np.uint64)
    out[np.arange(out.shape[1]) < size[:, None]] = column.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
    return out


def passes(bands: Bands, n: np.ndarray, m: np.ndarray, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the pairs of sizes ``n``, ``m`` and folded sketches that may be similar, and their distances."""
    at = np.flatnonzero(bands.b * np.minimum(n, m) >= bands.a * np.maximum(n, m))
    far = np.bitwise_count(x[at] ^ y[at]).sum(axis=1, dtype=np.int64)
    near = far <= bands.bound(n[at] + m[at])
    return at[near], far[near]


def spanning(u: np.ndarray, v: np.ndarray, weight: np.ndarray, label: np.ndarray) -> np.ndarray:
    """Places of the pairs (u, v) of a lightest forest that joins all labels which the pairs join; ``label`` is numbered from 0."""
    order = np.argsort(weight, kind="stable")
    a, b, chosen = label[u[order]], label[v[order]], []
    at = np.arange(len(order))
    while len(at):
        apart = a != b
        at, a, b = at[apart], a[apart], b[apart]
        lightest = np.full(len(label), len(order))
        np.minimum.at(lightest, a, at), np.minimum.at(lightest, b, at)
        picked = np.isin(at, lightest)
        chosen.append(at[picked])
        root = np.arange(len(label))
        x, y = a[picked], b[picked]
        while (root[x] != root[y]).any():
            low = np.minimum(root[x], root[y])
            np.minimum.at(root, root[x], low), np.minimum.at(root, root[y], low)
            root = root[root]
        a, b = root[a], root[b]
    return order[np.concatenate(chosen)] if chosen else order[:0]


def allowed(pairs: DataFrame, nodes: DataFrame, bands: Bands) -> DataFrame:
    """The ``pairs`` (u, v) whose folded sketches allow them to be similar."""
    side = lambda k: nodes.select(F.col("node").alias(k), *(F.col(c).alias(f"{k}_{c}") for c in ("n", "band", "fold", "up_fold")))
    both = pairs.join(side("u"), "u").join(side("v"), "v").where("abs(u_band - v_band) <= 1")
    fold = lambda k, other: F.when(F.col(f"{k}_band") < F.col(f"{other}_band"), F.col(f"{k}_up_fold")).otherwise(F.col(f"{k}_fold"))
    rows = both.select("u", "v", F.col("u_n").alias("n"), F.col("v_n").alias("m"), fold("u", "v").alias("x"), fold("v", "u").alias("y")).where("x is not null and y is not null")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, y = fold_matrix(b.column("x")), fold_matrix(b.column("y"))
            ok = pa.array(passes(bands, b.column("n").to_numpy(), b.column("m").to_numpy(), x, y)[0])
            yield pa.RecordBatch.from_arrays([b.column("u").take(ok), b.column("v").take(ok)], ["u", "v"])

    return rows.mapInArrow(run, "u long, v long")


def star_pairs(members: DataFrame) -> DataFrame:
    """(u, v) of each bucket's chosen member and its others in another component.

    The choice depends on the member alone, so buckets of the same documents mostly choose the same one and the
    pairs are few; sketches join them afterwards.
    """
    star = F.min(F.struct(F.xxhash64("node").alias("h"), "node", "component")).over(Window.partitionBy("key"))
    chosen = members.withColumn("star", star).where("star.component <> component")
    return chosen.select(F.least("node", "star.node").alias("u"), F.greatest("node", "star.node").alias("v")).distinct()


def tile_pairs(members: DataFrame, nodes: DataFrame, bands: Bands, salt: int | None = None) -> DataFrame:
    """(u, v, open) of all members of a bucket in different components whose coarse sketches allow it, tile by tile.

    With ``salt`` members meet only those they are dealt to a part with, and a part's pairs are thinned to a spanning forest;
    ``open`` lists the buckets of one part in which the pair was kept and others were not.
    """
    here = Window.partitionBy("key")
    fold = F.when(F.col("up"), F.col("up_coarse")).otherwise(F.col("coarse")).alias("fold")
    mixed = members.withColumns({"low": F.min("component").over(here), "high": F.max("component").over(here)}).where("low < high").drop("low", "high")
    chunks = F.ceil(F.col("rows") / TILE).cast("int")
    mixed = mixed.join(nodes.select("node", "n", "coarse", "up_coarse"), "node").select("key", "node", "component", "rows", "n", fold)
    dealt = mixed.withColumns({"chunks": chunks, "chunk": F.pmod(F.xxhash64("node") if salt is None else F.xxhash64("node", F.lit(salt)), chunks).cast("int")})
    other = F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)) if salt is None else F.col("chunk")
    tiles = dealt.withColumn("other", other).select("key", F.least("chunk", "other").alias("a"), F.greatest("chunk", "other").alias("b"), (F.col("chunk") > F.col("other")).alias("side"), (F.col("chunks") == 1).alias("alone"), "node", "component", "n", "fold")
    sorted_tiles = tiles.repartition("key", "a", "b").sortWithinPartitions("key", "a", "b")

    def compare(t: pa.Table) -> Iterator[pa.RecordBatch]:
        key, a, b = (t.column(c).to_numpy() for c in ("key", "a", "b"))
        node, component, n = (t.column(c).to_numpy() for c in ("node", "component", "n"))
        side = t.column("side").to_numpy() | (a == b)
        fold = fold_matrix(t.column("fold").combine_chunks())
        new = np.concatenate([[True], (key[1:] != key[:-1]) | (a[1:] != a[:-1]) | (b[1:] != b[:-1])])
        group = np.cumsum(new)
        u, v, distance = [], [], []
        alive = np.arange(len(group))
        for step in range(1, len(group)):
            alive = alive[alive + step < len(group)]
            alive = alive[group[alive] == group[alive + step]]
            if not len(alive):
                break
            x = alive[(component[alive] != component[alive + step]) & ((side[alive] != side[alive + step]) | (a[alive] == b[alive]))]
            if len(x):
                near, far = passes(bands, n[x], n[x + step], fold[x], fold[x + step])
                x = x[near]
                u.append(x), v.append(x + step), distance.append(far)
        if u:
            u, v = np.concatenate(u), np.concatenate(v)
            again = np.zeros(len(group), bool)
            if salt is not None:
                _, label = np.unique(np.stack([group, component]), axis=1, return_inverse=True)
                kept = spanning(u, v, np.concatenate(distance), label.ravel())
                before, after = (np.bincount(group[x], minlength=group[-1] + 1) for x in (u, u[kept]))
                u, v = u[kept], v[kept]
                again = (before > after)[group] & t.column("alone").to_numpy()
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(node[u], node[v])), pa.array(np.maximum(node[u], node[v])), pa.array(key[u], mask=~again[u])], ["u", "v", "open"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the tile that may go on in the next batch: at most 2 * TILE rows or so
        for batch in batches:
            t = pa.Table.from_batches([batch])
            t = pa.concat_tables([held, t]) if held is not None else t
            if not len(t):
                continue
            last = tuple(t.column(c)[-1].as_py() for c in ("key", "a", "b"))
            same = np.logical_and.reduce([t.column(c).to_numpy() == x for c, x in zip(("key", "a", "b"), last)])
            cut = int(np.flatnonzero(~same)[-1]) + 1 if not same.all() else 0
            held = t.slice(cut)
            if cut:
                yield from compare(t.slice(0, cut))
        if held is not None and len(held):
            yield from compare(held)

    return sorted_tiles.mapInArrow(run, "u long, v long, open long").groupBy("u", "v").agg(F.collect_set("open").alias("open"))


def unsettled(buckets: DataFrame, pairs: DataFrame) -> DataFrame:
    """The buckets that a forest round with these ``pairs`` (u, v, open) left pairs of to compare."""
    again = pairs.select(F.explode("open").alias("key")).distinct().withColumn("again", F.lit(True))
    return buckets.join(again, "key", "left").where((F.col("rows") > TILE) | F.col("again")).drop("again")


def shingle_sets(wanted: DataFrame, docs: DataFrame, width: int) -> DataFrame:
    """(node, set) of the nodes ``wanted`` (node, s1, s2), from the texts: sorted shingle hashes."""
    sieve = docs.sparkSession.sparkContext.broadcast(bitmap_of(wanted.select(F.col("s1").alias("value"))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap = sieve.value
        for batch in batches:
            for _, _, words in sliced_words(batch.column(0)):
                _, hashes, size = distinct_shingles(words, width)
                s1, s2 = signatures(hashes, size)
                ends = np.cumsum(size)
                hit = np.flatnonzero(in_bitmap(bitmap, s1) & (size > 0))
                _, at = np.unique(np.stack([s1[hit], s2[hit]]), axis=1, return_index=True)  # copies of a slice are one
                hit = hit[at]
                sets = pa.array([hashes[ends[i] - size[i] : ends[i]].tobytes() for i in hit], pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(as_signed(s1[hit])), pa.array(as_signed(s2[hit])), sets], ["s1", "s2", "set"])

    found = docs.select("text").mapInArrow(run, "s1 long, s2 long, set binary")
    return found.join(wanted, ["s1", "s2"]).groupBy("node").agg(F.first("set").alias("set"))


def linked(pairs: DataFrame, sets: DataFrame, bands: Bands) -> DataFrame:
    """The pairs (u, v) of nodes whose shingle ``sets`` (node, set) are similar, by exact comparison of the sets."""

    def same(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ok = np.zeros(b.num_rows, bool)
            for i in range(b.num_rows):
                x, y = (np.frombuffer(b.column(c)[i].as_buffer(), np.uint64) for c in ("x", "y"))
                both = len(np.intersect1d(x, y, assume_unique=True))
                ok[i] = bands.b * both >= bands.a * (len(x) + len(y) - both)
            yield pa.RecordBatch.from_arrays([b.column("u").filter(pa.array(ok)), b.column("v").filter(pa.array(ok))], ["u", "v"])

    joined = pairs.join(sets.withColumnsRenamed({"node": "u", "set": "x"}), "u").join(sets.withColumnsRenamed({"node": "v", "set": "y"}), "v")
    return materialise(joined.mapInArrow(same, "u long, v long"), "links")


def similar_documents(docs: DataFrame, width: int = 3, similarity: tuple[int, int] = (90, 100), id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, n_shingles, component_id) of every row of ``docs``.

    Words are runs of bytes outside space and 0x09-0x0D with A-Z lowered; a set holds the distinct runs of
    ``width`` words, of a shorter text its one run. Two rows link when b * |A & B| >= a * |A | B| for
    ``similarity`` (a, b). component_id is the smallest id reachable over links. A null text, or one without
    words, has no shingles, links with nothing and keeps its own id. Repeated ids and rows stay separate rows;
    rows with a null id link like others, and such an id counts only where a component has no other. Other
    columns are not read. An empty table gives an empty result. Very long texts are worked on whole: a text above the
    size of a slice is a slice of its own.
    """
    bands = Bands(*similarity)
    plain = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"))
    rows = materialise(set_table(plain, width, bands), "sets")
    one = materialise(rows.where("n > 0").groupBy("s1", "s2").agg(F.min("id").alias("id"), F.min("row").alias("node")), "set-names")
    of_one = rows.select(F.col("row").alias("node"), "s1", "s2", "n", "band", *(up + c for up in ("", "up_") for c in ("keys", "fold", "coarse")))
    nodes = of_one.join(one.select("node"), "node", "left_semi")
    buckets = materialise(bucket_table(nodes), "buckets")
    nodes = materialise(nodes.drop("keys", "up_keys").join(buckets.select("node").distinct(), "node", "left_semi"), "set-nodes")

    links = None
    rows_of = buckets.withColumn("component", F.col("node"))
    for k in range(FOREST_ROUNDS + 2):
        met = star_pairs(rows_of) if k == 0 else materialise(tile_pairs(rows_of, nodes, bands, k if k <= FOREST_ROUNDS else None), "met")
        pairs = materialise(allowed(met, nodes, bands), "pairs")
        wanted = pairs.select(F.col("u").alias("node")).union(pairs.select("v")).distinct().join(nodes.select("node", "s1", "s2"), "node")
        sets = materialise(shingle_sets(materialise(wanted, "set-wanted"), plain, width), "sets-wanted")
        found = linked(pairs, sets, bands)
        links = found if links is None else links.union(found)
        labels = connected_components(links)
        going = buckets.where("rows > 2") if k == 0 else unsettled(buckets, met)
        rows_of = going.join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))

    named = labels.join(one.select("node", "id"), "node").groupBy("component").agg(F.min("id").alias("component_id"))
    known = one.join(labels, "node", "left").join(named, "component", "left").select("s1", "s2", F.coalesce("component_id", "id").alias("component_id"))
    out = rows.select("id", "n", "s1", "s2").join(known, ["s1", "s2"], "left")
    own = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("id"))
    return out.select(F.col("id").alias(id_column), F.col("n").alias("n_shingles"), own.alias("component_id"))
