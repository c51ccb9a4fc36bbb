"""A corpus pipeline: language, near duplicates, benchmark passages, packing.

``STAGES`` are applied to ``documents`` in order; each is written as Parquet and read again as the documents of the
next. A stage takes (spark, docs, sf_dir), works on every row it gets, and its decisions take effect. All
but the last return the columns of their input. Rows are told apart by id and text, so repeated ids, null ids
and repeated rows need no special input; an empty table passes through as an empty table. Further columns may have any
name and come through unchanged; very long texts are worked on whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions.storage import materialise
from plumbline.llm import contamination, jaccard, language, packing
from plumbline.llm.registry import table, vocabulary

#: Below this mean probability no language is accepted (even odds among two are 0.5).
MIN_LANGUAGE_SCORE = 0.4


def with_key(docs: DataFrame) -> DataFrame:
    """(key, text): id and a hash of the text tell rows apart."""
    return docs.select(F.struct("doc_id", F.xxhash64("text").alias("text_hash")).alias("key"), "text")



def keep_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised: null texts, texts without letters and unclear ones go."""
    others = {c: f"__kept_{i}" for i, c in enumerate(docs.columns) if c not in ("doc_id", "text")}
    carried = docs.select("doc_id", "text", *(F.col(c).alias(n) for c, n in others.items()), *([F.col("lang")] if "lang" in others else []))
    found = language.predict_language(carried, F.lit(True), keep=("text", *others.values()))
    clear = (F.col("lang_pred") != "und") & (F.col("score") >= MIN_LANGUAGE_SCORE)
    return found.where(clear).select(*(F.col(others.get(c, c)).alias(c) for c in docs.columns))


def matched(docs: DataFrame, keys: DataFrame, how: str) -> DataFrame:
    """``docs`` semi- or anti-joined with ``keys`` (key)."""
    same = F.col("docs.doc_id").eqNullSafe(F.col("keys.key.doc_id")) & (F.xxhash64("docs.text") == F.col("keys.key.text_hash"))
    return docs.alias("docs").join(keys.alias("keys"), same, how)


def without(docs: DataFrame, keys: DataFrame) -> DataFrame:
    """``docs`` without the rows of ``keys`` (key)."""
    return matched(docs, keys, "left_anti")


def keep_one_of_similar(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by a Jaccard similarity of 5-word shingles of at least 0.8: the smallest id.

    Texts without words are in no group and stay.
    """
    rows = materialise(jaccard.similar_documents(with_key(docs), width=5, similarity=(80, 100), id_column="key"), "similar").where("n_shingles > 0")
    gone = rows.where(~F.col("key").eqNullSafe(F.col("component_id"))).select("key").distinct()
    left = without(docs, gone)
    repeated = rows.where(F.col("key").eqNullSafe(F.col("component_id"))).groupBy("key").count().where("count > 1")
    if repeated.isEmpty():
        return left
    twice = matched(left, repeated.select("key"), "left_semi").dropDuplicates(["doc_id", "text"])
    return matched(left, repeated.select("key"), "left_anti").unionByName(twice)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item to at least 0.8 of its 5-word shingles."""
    found = contamination.find_items(with_key(docs), table(spark, sf_dir, "benchmark"), id_column="key")
    return without(docs, found.select("key").distinct())


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 2048 tokens with their sequence and offset."""
    pieces = packing.cut_documents(docs, vocabulary("byte_bpe_50k.json"), "kept", end_id=0)
    return packing.pack(pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids"))


STAGES = [
    ("language_id", keep_language),
    ("ngram_jaccard_join", keep_one_of_similar),
    ("benchmark_decontamination", drop_contaminated),
    ("best_fit_packing", pack_sequences),
]

#: A recurrent network has no SQL twin; the tests compare with a brute-force pipeline.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
