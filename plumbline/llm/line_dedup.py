"""Line dedup that can be undone: sharded cuckoo filters before exact reference-count tables.

A line's key is the line without white space at both ends, A-Z lowered; keys below a length are never repeated. The
index keeps, as tables in the shared folder,

* postings: a row per line (128-bit key, document, row hash, position),
* references: per key the number of lines that hold it and its smallest and largest document,
* filters: per shard of keys a cuckoo filter with an entry for every key that is referenced.

``insert`` reduces a batch to its keys and asks the filters of their shards: a key without an entry is certainly new and
meets no other table, the rest is joined with the exact references, which also finds the false alarms. ``delete``
lowers the counts of the deleted documents' keys, finds the next smallest document from the postings and takes
entries out where the count falls to nothing, which Bloom filters could not do. ``kept_texts`` drops a repeated key
everywhere but in its smallest document. The result after any inserts and deletions is that of a new index over the
documents left.

An index is a value: operations return a new one and write only the keys they touch. Keys of which one holds a large
share of all lines (at most ``HOT`` of them can hold a 1/``HOT``-th) are broadcast, the others are spread by hash.

Edge cases: a null text is one empty line; a null id counts as one more document, after all others; rows that repeat an
id are parts of one document; empty tables give empty indexes; other columns stay out of the way. A very long text is
one row of lines in Spark's memory and is never cut.
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.storage import materialise
from . import cuckoo

MIN_LENGTH = 10
#: Keys a shard should hold; the number of shards is fixed when an index is created.
KEYS_PER_SHARD = 10_000
HOT = 1024
#: Parts of the reference table that are read together before they are made one.
PARTS = 8

KEY = ["h1", "h2"]
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


@dataclass(frozen=True)
class LineIndex:
    postings: DataFrame
    references: tuple[DataFrame, ...]
    filters: DataFrame
    shards: int
    min_length: int


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def row_hash() -> Column:
    """Tells rows with the same id and different texts apart."""
    return F.xxhash64("doc_id", "text")


def line_postings(docs: DataFrame, min_length: int = MIN_LENGTH) -> DataFrame:
    """(doc_id, row, position, h1, h2) of every line whose key has at least ``min_length`` code points."""
    lines = docs.select("doc_id", row_hash().alias("row"), F.posexplode(lines_of(F.col("text"))).alias("position", "line"))
    key = F.translate(F.btrim("line", F.lit(" \t\n\x0b\x0c\r")), _UPPER, _UPPER.lower())
    keyed = lines.select("doc_id", "row", "position", key.alias("key")).where(F.char_length("key") >= min_length)
    return keyed.select("doc_id", "row", "position", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit("line"), "key").alias("h2"))


def shard_of(shards: int) -> Column:
    return F.pmod(F.col("h1"), F.lit(shards)).cast("int").alias("shard")


def counted(postings: DataFrame) -> DataFrame:
    """References of a set of postings, added up before the shuffle."""
    return postings.groupBy(*KEY).agg(
        F.count("*").alias("n_lines"), F.min("doc_id").alias("first_doc"), F.max("doc_id").alias("last_doc"),
        F.count_if(F.col("doc_id").isNull()).alias("n_null"),
    )


def _merged(a: str, b: str) -> list[Column]:
    """References of keys known to two tables, either of which may lack them."""
    both = lambda name: F.coalesce(f"{a}.{name}", F.lit(0)) + F.coalesce(f"{b}.{name}", F.lit(0))
    return [
        both("n_lines").alias("n_lines"), F.least(f"{a}.first_doc", f"{b}.first_doc").alias("first_doc"),
        F.greatest(f"{a}.last_doc", f"{b}.last_doc").alias("last_doc"), both("n_null").alias("n_null"),
    ]


def references(index: LineIndex) -> DataFrame:
    """(h1, h2, n_lines, first_doc, last_doc, n_null) as of now; keys that nothing holds any more are left out."""
    if len(index.references) == 1:
        return index.references[0].where("n_lines > 0")
    parts = reduce(DataFrame.unionByName, (part.withColumn("version", F.lit(i)) for i, part in enumerate(index.references)))
    latest = [F.max_by(c, "version").alias(c) for c in ("n_lines", "first_doc", "last_doc", "n_null")]
    return parts.groupBy(*KEY).agg(*latest).where("n_lines > 0")


def _hashes(keys: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    return cuckoo.places(*(keys.column(c).to_numpy().astype(np.int64) for c in KEY))


def _stored(filters: pa.Table) -> np.ndarray:
    return cuckoo.load(filters.column("tables")[0].as_py() if filters.num_rows else None)


def _probe(keys: pa.Table, filters: pa.Table) -> pa.Table:
    """Keys with ``maybe``: whether the filter has an entry; shards without keys in the batch give nothing."""
    found = cuckoo.contains(_stored(filters), *_hashes(keys)) if keys.num_rows else []
    return keys.append_column("maybe", pa.array(found, pa.bool_()))


def _changed(keys: pa.Table, filters: pa.Table) -> pa.Table:
    """The filter of a shard after the keys of ``keys`` came (``enters``) or left."""
    shard = (keys if keys.num_rows else filters).column("shard")[0].as_py()
    tables = _stored(filters)
    if keys.num_rows:
        print_, bucket = _hashes(keys)
        enters = keys.column("enters").to_numpy(zero_copy_only=False)
        if (lost := cuckoo.delete(tables, print_[~enters], bucket[~enters]) if not enters.all() else 0):
            raise ValueError(f"{lost} keys had no entry in the filter of shard {shard}")
        tables = cuckoo.insert(tables, print_[enters], bucket[enters])
    return pa.table({"shard": pa.array([shard], pa.int32()), "tables": pa.array([tables.tobytes()], pa.binary())})


def _by_shard(keys: DataFrame, filters: DataFrame, fn, schema: str) -> DataFrame:
    return keys.groupBy("shard").cogroup(filters.groupBy("shard")).applyInArrow(fn, schema)


def _with_filters(index: LineIndex, keys: DataFrame) -> LineIndex:
    """``keys``: (h1, h2, enters)."""
    changes = keys.select(shard_of(index.shards), *KEY, "enters")
    return replace(index, filters=materialise(_by_shard(changes, index.filters, _changed, "shard int, tables binary"), "line-filters"))


def _with_references(index: LineIndex, changed: DataFrame) -> LineIndex:
    out = replace(index, references=(*index.references, changed))
    if len(out.references) <= PARTS:
        return out
    return replace(out, references=(materialise(references(out), "line-references"),))


def new_index(docs: DataFrame, min_length: int = MIN_LENGTH, shards: int | None = None) -> LineIndex:
    """An index of ``docs`` (doc_id, text). Without ``shards`` their number follows the number of lines."""
    spark = docs.sparkSession
    postings = materialise(line_postings(docs, min_length), "line-postings")
    shards = shards or max(16, postings.count() // KEYS_PER_SHARD)
    table = materialise(counted(postings), "line-references")
    empty = spark.createDataFrame([], "shard int, tables binary")
    return _with_filters(LineIndex(postings, (table,), empty, shards, min_length), table.select(*KEY, F.lit(True).alias("enters")))


def insert(index: LineIndex, docs: DataFrame) -> LineIndex:
    """The index with ``docs`` (doc_id, text) added."""
    postings = materialise(line_postings(docs, index.min_length), "line-postings")
    batch = counted(postings).select(shard_of(index.shards), "*")
    kind = dict(batch.dtypes)
    schema = ", ".join(f"{c} {kind[c]}" for c in batch.columns)
    probed = materialise(_by_shard(batch, index.filters, _probe, f"{schema}, maybe boolean"), "line-batch")
    new = probed.where("not maybe")
    hits, known = probed.where("maybe").alias("a"), references(index).alias("b")
    joined = hits.join(known, (F.col("a.h1") == F.col("b.h1")) & (F.col("a.h2") == F.col("b.h2")), "left")
    enters = F.col("b.h1").isNull().alias("enters")
    merged = joined.select(F.col("a.h1").alias("h1"), F.col("a.h2").alias("h2"), *_merged("a", "b"), enters)
    changed = materialise(merged.unionByName(new.select(*KEY, "n_lines", "first_doc", "last_doc", "n_null", F.lit(True).alias("enters"))), "line-references")
    grown = _with_references(index, changed.drop("enters"))
    return replace(_with_filters(grown, changed.where("enters").select(*KEY, "enters")), postings=index.postings.unionByName(postings))


def delete(index: LineIndex, ids: DataFrame) -> LineIndex:
    """The index without the documents of ``ids`` (doc_id); ids it does not hold change nothing."""
    gone_ids = ids.select(F.col("doc_id").alias("gone_id")).distinct()
    same = F.col("doc_id").eqNullSafe(F.col("gone_id"))
    touched = materialise(index.postings.join(gone_ids, same, "left_semi").select(*KEY).distinct(), "line-touched")
    left = index.postings.join(gone_ids, same, "left_anti")
    now = counted(left.join(touched, KEY, "left_semi"))
    rest = touched.join(now, KEY, "left").select(*KEY, F.coalesce("n_lines", F.lit(0)).alias("n_lines"), "first_doc", "last_doc", F.coalesce("n_null", F.lit(0)).alias("n_null"))
    changed = materialise(rest, "line-references")
    shrunk = _with_references(index, changed)
    return replace(_with_filters(shrunk, changed.where("n_lines = 0").select(*KEY, F.lit(False).alias("enters"))), postings=left)


def repeated(index: LineIndex) -> DataFrame:
    """(h1, h2, n_lines, first_doc) of keys that at least two documents hold."""
    several = (F.col("first_doc") != F.col("last_doc")) | ((F.col("n_null") > 0) & (F.col("n_null") < F.col("n_lines")))
    return references(index).where(several).select(*KEY, "n_lines", "first_doc")


def dropped_lines(index: LineIndex) -> DataFrame:
    """(doc_id, row, position) of every line that goes."""
    keys = materialise(repeated(index), "line-repeated")
    share = index.postings.count() / HOT
    outside = ~F.col("doc_id").eqNullSafe(F.col("first_doc"))
    hot = F.broadcast(keys.where(F.col("n_lines") > share))  # at most HOT rows
    of_hot = index.postings.join(hot, KEY)
    of_others = index.postings.join(hot, KEY, "left_anti").join(keys.where(F.col("n_lines") <= share), KEY)
    return of_hot.unionByName(of_others).where(outside).select("doc_id", "row", "position")


def kept_texts(index: LineIndex, docs: DataFrame) -> DataFrame:
    """(doc_id, n_lines, n_dropped, kept_text) of the rows of ``docs``, which the index holds."""
    gone = dropped_lines(index).groupBy(F.col("doc_id").alias("gone_id"), F.col("row").alias("gone_row")).agg(F.collect_set("position").alias("gone"))
    rows = docs.select("doc_id", "text", row_hash().alias("row"))
    met = rows.join(gone, (F.col("row") == F.col("gone_row")) & F.col("doc_id").eqNullSafe(F.col("gone_id")), "left")
    lines = lines_of(F.col("text"))
    stay = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), "gone")
    met = met.select("doc_id", "text", "gone", lines.alias("lines")).withColumn("stay", F.when(F.col("gone").isNotNull(), stay))
    kept = F.when(F.col("gone").isNull(), F.coalesce("text", F.lit(""))).otherwise(F.array_join(F.transform("stay", lambda i: F.get("lines", i)), "\n"))
    n = F.size("lines").cast("long")
    return met.select("doc_id", n.alias("n_lines"), F.when(F.col("stay").isNull(), F.lit(0)).otherwise(n - F.size("stay")).cast("long").alias("n_dropped"), kept.alias("kept_text"))
