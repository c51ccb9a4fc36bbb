import random

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from test_contamination import brute as contaminated
from test_jaccard import brute as similar

import corpus_pipeline
from plumbline.functions.storage import materialise

WORDS = {"en": "the of and that with from have this will your".split(), "de": "der und nicht schön über auf eine wird sich mit".split()}


@pytest.fixture
def folder(tmp_path):
    rng = random.Random(8)
    say = lambda lang, n: " ".join(rng.choice(WORDS[lang]) + rng.choice(["", "er", "en", "st"]) for _ in range(n))
    items = [(i, say("en", rng.choice([4, 14, 40]))) for i in range(6)]
    docs = [(i, say(lang, rng.randint(20, 120)), lang) for i, lang in enumerate(rng.choices(["en", "de"], k=120))]
    for i in range(40):
        words = docs[rng.randrange(60)][1].split()
        words[rng.randrange(len(words))] = rng.choice(["x", "y"])
        docs.append((200 + i, " ".join(words), "en"))
    docs += [(300 + i, say("en", 30) + "\n" + items[i % 6][1].upper() + " " + say("en", 20), "en") for i in range(12)]
    docs += [(400, None, "en"), (401, "", None), (402, "12 34 !", "de"), (403, docs[0][1], None), (3, docs[3][1], docs[3][2]), (None, say("de", 40), "de"), (None, say("de", 40), "de")]
    schema = {"doc_id": pa.int64(), "text": pa.string(), "lang": pa.string()}
    pq.write_table(pa.table({n: pa.array([d[k] for d in docs], t) for k, (n, t) in enumerate(schema.items())} | {"source": ["s"] * len(docs), "n_chars": [len(d[1] or "") for d in docs]}), tmp_path / "documents.parquet")
    pq.write_table(pa.table({"item_id": [i for i, _ in items], "text": [t for _, t in items]}), tmp_path / "benchmark.parquet")
    return str(tmp_path), docs, items


def test_every_stage_takes_effect(spark, folder):
    path, docs, items = folder
    left = [(d, t) for d, t, _ in docs if t and any(c.isalpha() for c in t)]
    stages = dict(corpus_pipeline.STAGES)
    frame = spark.read.parquet(f"{path}/documents.parquet")
    columns = frame.columns
    frame = materialise(stages["language_id"](spark, frame, path), "a")
    order = lambda rows: sorted(((r[0], r[1]) for r in rows), key=str)
    assert frame.columns == columns and order(frame.select("doc_id", "text").collect()) == order(left)

    # groups: every row its own number, so that repeated and null ids are told apart
    numbered = [(k, t) for k, (_, t) in enumerate(left)]
    groups = {}
    for k, _, component in similar(numbered, 5, 80, 100):
        groups.setdefault(component, []).append(k)
    frame = materialise(stages["ngram_jaccard_join"](spark, frame, path), "b")
    rows = frame.collect()
    assert frame.columns == columns and len(rows) == len(groups) < len(left)
    key = lambda k: (left[k][0] is not None, left[k][0] or 0)
    chosen = [min(members, key=key) for members in groups.values()]
    assert sorted(str(r.doc_id) for r in rows) == sorted(str(left[k][0]) for k in chosen)

    left = [(r.doc_id, r.text) for r in rows]
    hit = {k for k, *_ in contaminated([(k, t) for k, (_, t) in enumerate(left)], items)}
    frame = materialise(stages["benchmark_decontamination"](spark, frame, path), "c")
    assert hit and frame.columns == columns and order(frame.select("doc_id", "text").collect()) == order([x for k, x in enumerate(left) if k not in hit])

    packed = stages["best_fit_packing"](spark, frame, path).collect()
    assert {r.doc_id for r in packed} == {x[0] for k, x in enumerate(left) if k not in hit}
    full = sorted((tuple(r) for r in packed), key=str)
    by_run = corpus_pipeline.run(spark, path)
    drop = [c for c in by_run.columns if c not in ("sequence_id", "offset")]
    at = [by_run.columns.index(c) for c in drop]
    assert sorted(([r[i] for i in at] for r in by_run.collect()), key=str) == sorted(([r[i] for i in at] for r in full), key=str)


def test_empty_documents(spark, folder, tmp_path):
    path, *_ = folder
    table = pq.read_table(f"{path}/documents.parquet")
    pq.write_table(table.slice(0, 0), tmp_path / "documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_columns_of_any_name_come_through(spark, folder):
    path, docs, _ = folder
    frame = spark.read.parquet(f"{path}/documents.parquet")
    odd = ["score", "lang_pred", "__letters", "gone_id", "again_id", "key", "keys", "docs", "text_hash", "held_out", "component_id", "__kept_0"]
    wide = frame.selectExpr("*", *(f"concat('{c}-', doc_id) as `{c}`" for c in odd))
    plain = frame
    for name, stage in corpus_pipeline.STAGES[:-1]:
        wide, plain = materialise(stage(spark, wide, path), name), materialise(stage(spark, plain, path), name)
        assert wide.columns == [*frame.columns, *odd]
        ids = lambda f: sorted((str(r.doc_id), r.text) for r in f.select("doc_id", "text").collect())
        assert ids(wide) == ids(plain)
    assert wide.where("doc_id is not null").where(" or ".join(f"`{c}` <> concat('{c}-', doc_id)" for c in odd)).isEmpty()
