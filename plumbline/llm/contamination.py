"""Benchmark passages inside documents: MinHash containment search by size class, then exact shingles.

Items fall into size classes by their number of distinct shingles (a class reaches from a power of
``GROWTH`` to the next). The sketch of an item is the ``k`` smallest values of its shingles under one
min-wise hash, with k = n - ceil(threshold * n) + 1 for the largest n of its class: a document that contains at
least ``threshold`` of an item's shingles can miss at most k - 1 of them, so it holds one of the sketch. The
search therefore loses nothing, however short the item and however long the document.

Documents are read once for candidates. A bitmap of fixed size over the sketch values (the only thing that is
sent to all tasks) drops nearly all shingles where they arise; the rest meets the sketches in a join on the
value. Long documents are worked off in slices of bounded size. Candidate pairs are then counted exactly on
the words themselves.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.storage import materialise
from .bitmaps import bitmap_of, in_bitmap
from .texts import as_signed, as_text, sliced_words, words_of

WIDTH = 5
THRESHOLD = 0.8
GROWTH = 1.5


def size_class(n: int, growth: float = GROWTH) -> tuple[int, int]:
    """The smallest and the largest size of the class that holds ``n``."""
    low = 1
    while True:
        high = max(low, int(low * growth))
        if n <= high:
            return low, high
        low = high + 1


def sketch_length(n: int, threshold: float = THRESHOLD) -> int:
    """Sketch values needed so that no item of up to ``n`` shingles is missed at ``threshold``."""
    need = -(-round(threshold * 1_000_000) * n // 1_000_000)
    return n - need + 1


def item_sketches(items: DataFrame, width: int, threshold: float, item_column: str, text_column: str) -> DataFrame:
    """(item, value) sketch rows; items without words have none."""
    kind = items.schema[item_column].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = as_text(batch.column(1))
            rows, values = [], []
            for i in range(len(text)):
                _, hashes = words_of(text.slice(i, 1)).shingles(width)
                hashes = np.unique(hashes)  # the hash order is the min-wise order
                if len(hashes):
                    some = hashes[: sketch_length(size_class(len(hashes))[1], threshold)]
                    rows += [i] * len(some)
                    values.append(some)
            found = np.concatenate(values) if values else np.zeros(0, np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), pa.array(as_signed(found))], ["item", "value"])

    plain = items.select(F.col(item_column).alias("item"), F.col(text_column).alias("text"))
    return plain.mapInArrow(run, f"item {kind}, value long").distinct()


def _shingle_words(text: str | None, width: int) -> set[bytes]:
    data = (text or "").encode()
    if not data:
        return set()
    words = words_of(as_text(pa.array([text])))
    n = len(words.hash)
    spans = [(i, min(i + width, n) - 1) for i in range(max(1, n - width + 1))] if n else []
    return {b" ".join(words.word(k) for k in range(a, b + 1)) for a, b in spans}


def find_items(
    docs: DataFrame, items: DataFrame, width: int = WIDTH, threshold: float = THRESHOLD,
    id_column: str = "doc_id", text_column: str = "text", item_column: str = "item_id", item_text: str = "text",
) -> DataFrame:
    """(id, item, n_shingles, n_found, containment) of every document row and item with containment >= threshold.

    Words are runs of bytes outside space and 0x09-0x0D with A-Z lowered; shingles are distinct runs of ``width``
    words, a shorter item is one shingle of all its words and is looked for among the runs of its own length.
    Null or empty texts and items are found nowhere. Repeated document rows give repeated result rows; items
    with equal texts are all reported. Null ids are kept. Other columns are not read.
    """
    doc_kind, item_kind = docs.schema[id_column].dataType.simpleString(), items.schema[item_column].dataType.simpleString()
    bench = items.select(F.col(item_column).alias("item"), F.col(item_text).alias("item_text"))
    sketches = materialise(item_sketches(items, width, threshold, item_column, item_text), "item-sketches")
    shared = docs.sparkSession.sparkContext.broadcast(bitmap_of(sketches))  # 2 MB whatever the input
    short = short_widths(bench, width)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap = shared.value
        for batch in batches:
            for start, _, words in sliced_words(batch.column(1)):
                rows, values = [], []
                for w in (width, *short):
                    row, hashes = words.shingles(w)
                    hit = in_bitmap(bitmap, hashes)
                    rows.append(row[hit]), values.append(hashes[hit])
                row, value = np.concatenate(rows), np.concatenate(values)
                if len(row):
                    pairs = np.unique(np.stack([row.astype(np.uint64), value]), axis=1)
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(pairs[0].astype(np.int64) + start)), batch.column(2).take(pa.array(pairs[0].astype(np.int64) + start)), pa.array(as_signed(pairs[1]))], ["id", "twin", "value"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for i, (text, item_text) in enumerate(zip(batch.column("text").to_pylist(), batch.column("item_text").to_pylist())):
                wanted = _shingle_words(item_text, width)
                own = min(width, max(x.count(b" ") + 1 for x in wanted))
                found = len(wanted & _shingle_words(text, own))
                if found and found >= threshold * len(wanted) - 1e-9:
                    out.append((i, len(wanted), found))
            rows = pa.array([x[0] for x in out], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("id").take(rows), batch.column("item").take(rows), batch.column("copies").take(rows), pa.array([x[1] for x in out], pa.int64()), pa.array([x[2] for x in out], pa.int64()), pa.array([x[2] / x[1] for x in out], pa.float64())], ["id", "item", "copies", "n_shingles", "n_found", "containment"])

    # rows with equal id and text are one row here and are dealt out again at the end
    plain = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"))
    twin = F.xxhash64("text")
    hits = plain.withColumn("twin", twin).mapInArrow(run, f"id {doc_kind}, twin long, value long")
    pairs = materialise(hits.join(sketches, "value").select("id", "twin", "item").distinct(), "item-candidates")
    wanted = pairs.select("id", "twin").distinct()
    same = (F.col("d.id").eqNullSafe(F.col("w.id"))) & (F.col("d.twin") == F.col("w.twin"))
    texts = plain.withColumn("twin", twin).alias("d").join(wanted.alias("w"), same, "left_semi").groupBy("id", "twin", "text").agg(F.count(F.lit(1)).alias("copies"))
    joined = pairs.alias("p").join(texts.alias("t"), F.col("p.id").eqNullSafe(F.col("t.id")) & (F.col("p.twin") == F.col("t.twin"))).join(bench.alias("b"), F.col("p.item").eqNullSafe(F.col("b.item")))
    counted = joined.select("p.id", "p.item", "t.copies", "t.text", "b.item_text").mapInArrow(count, f"id {doc_kind}, item {item_kind}, copies long, n_shingles long, n_found long, containment double")
    each = counted.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).drop("copy", "copies")
    return each.withColumnsRenamed({"id": id_column, "item": item_column})


def short_widths(bench: DataFrame, width: int) -> list[int]:
    """Lengths of items with fewer than ``width`` words: at most width - 1 numbers."""
    trimmed = F.regexp_replace(F.coalesce("item_text", F.lit("")), r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", "")
    words = F.when(trimmed == "", 0).otherwise(F.size(F.split(trimmed, r"[\x20\x09-\x0D]+")))
    return sorted(r[0] for r in bench.select(words.alias("n")).where(F.col("n").between(1, width - 1)).distinct().collect())
