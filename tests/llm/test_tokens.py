import random
import zlib

import numpy as np
import pytest

from plumbline.llm import token_counts, token_files
from plumbline.llm.encode import UnitEncoder
from plumbline.llm.registry import vocabulary

SCHEMA = "doc_id long, text string, id string, n_tokens string"
PIECES = ["a", "B", "'s", "'S", " ", "  ", "   ", "\n", "\t", " \n", "\x1c", "\x85", " ", "é", "é", "́", "İ", "Σ", "12", "½", ",", "<|endoftext|>", "<|startoftext|>", "▁", "don't", "中文", "😀", "\x00"]


def samples(n=400, seed=3):
    rng = random.Random(seed)
    return ["".join(rng.choices(PIECES, k=rng.randint(0, 12))) for _ in range(n)]


def docs_of(spark, texts):
    return spark.createDataFrame([(i, t, "x", "y") for i, t in enumerate(texts)], SCHEMA)


@pytest.mark.parametrize("name, space", [("byte_bpe_50k.json", "kept"), ("word_bpe_49k.json", "dropped")])
def test_units_give_the_ids_of_whole_texts(name, space):
    encoder = UnitEncoder(vocabulary(name), space, keep_units=50)
    texts = samples(1500) + ["x" * 5000, " ".join(["word"] * 3000)]
    for i in range(0, len(texts), 100):
        some = texts[i : i + 100]
        expected = [np.array(e.ids, "<u4").tobytes() for e in encoder.tokenizer.encode_batch(some, add_special_tokens=False)]
        assert encoder.encode(some) == expected


def test_token_counts_match_whole_text_calls(spark):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=vocabulary("piece_bpe_32k.model"))
    texts = [*samples(), None, "", " ", "a ", " a", "word, " * 9000, "  \n " * 9000, "x" * 40000]
    rows = token_counts.count_tokens(docs_of(spark, texts).unionAll(docs_of(spark, texts[:3])), vocabulary("piece_bpe_32k.model")).collect()
    assert len(rows) == len(texts) + 3
    for r in rows:
        text = texts[r.doc_id] or ""
        assert (r.n_bytes, r.n_tokens) == (len(text.encode()), len(model.encode(text)))
    counter = token_counts.PieceCounter(vocabulary("piece_bpe_32k.model"), piece_chars=3)
    assert list(counter.counts(texts[:400])) == [len(x) for x in model.encode(texts[:400])]


def test_token_files_round_trip(spark):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(vocabulary("word_bpe_49k.json"))
    texts = [*samples(200), None, "", "word " * 6000, *["same"] * 50]
    docs = docs_of(spark, texts).repartition(5)
    manifest = token_files.write_token_files(docs, vocabulary("word_bpe_49k.json"), "dropped", 2, length=16)
    rows = sorted(token_files.read_token_files(manifest).collect())
    start = 0
    stream = []
    for i, (doc_id, begin, ids) in enumerate(rows):
        expected = [*plain.encode(texts[i] or "", add_special_tokens=False).ids, 2]
        assert (doc_id, begin) == (i, start)
        assert zlib.crc32(bytes(ids)) == zlib.crc32(np.array(expected, "<u4").tobytes())
        start += len(expected)
        stream += expected
    assert len(rows) == len(texts)
    place = 0
    for part in sorted(manifest.collect(), key=lambda r: r.part):
        reader = token_files.SequenceReader(part.file)
        assert part.start == place
        for k in (0, part.n_sequences // 2, part.n_sequences - 1):
            ids, mask = reader.sequence(k)
            at = place + 16 * k
            assert list(ids[mask]) == stream[at : min(at + 16, place + part.n_tokens)]
            assert not ids.flags.owndata
        place += part.n_tokens


def test_token_files_of_ties_nulls_and_no_rows(spark):
    rows = [(1, "b", "x", "y"), (1, "a", "x", "y"), (None, "n", "x", "y"), (1, "a", "x", "y")]
    for rows, n in ((rows, 4), ([], 0)):
        manifest = token_files.write_token_files(spark.createDataFrame(rows, SCHEMA), vocabulary("word_bpe_49k.json"), "dropped", 2)
        back = token_files.read_token_files(manifest).collect()
        assert len(back) == n and sorted(r.start for r in back) == [2 * i for i in range(n)]
        if n:
            assert min(back, key=lambda r: r.start).doc_id is None
    assert token_counts.count_tokens(spark.createDataFrame([], SCHEMA), vocabulary("piece_bpe_32k.model")).count() == 0


def test_ids_come_back_in_their_own_type(spark):
    docs = spark.createDataFrame([("b", "two words"), ("a", "one"), (None, "")], "doc_id string, text string")
    manifest = token_files.write_token_files(docs, vocabulary("word_bpe_49k.json"), "dropped", 2)
    back = token_files.read_token_files(manifest)
    assert dict(back.dtypes)["doc_id"] == "string" and {r.doc_id for r in back.collect()} == {"a", "b", None}
