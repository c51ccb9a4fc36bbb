import os
import uuid
from collections import Counter

import numpy as np
from pyspark import TaskContext
from pyspark.sql import functions as F

from plumbline.llm import language as lang

SCHEMA = "doc_id long, text string, lang string, lang_pred string, score string"


def small(seed=0):
    rng = np.random.default_rng(seed)
    data = rng.integers(0, 256, 60).astype(np.uint8)
    return lang.new_weights(3, 4, rng), lang.Lanes(data, np.array([0, 20, 33, 58]), np.array([20, 13, 20, 2])), rng


def test_gradients_equal_differences():
    w, lanes, rng = small()
    w = {k: v.astype(np.float64) for k, v in w.items()}
    label = np.array([0, 2, 1, 1])
    _, grads = lang.loss_gradients(w, lanes, label)
    for name, values in w.items():
        flat = values.ravel()
        places = np.flatnonzero(np.abs(grads[name]).ravel() > 1e-5)
        for i in rng.choice(places, 4):
            at, step = flat[i], 1e-2
            flat[i] = at + step
            up = lang.loss_gradients(w, lanes, label)[0]
            flat[i] = at - step
            down = lang.loss_gradients(w, lanes, label)[0]
            flat[i] = at
            assert abs((up - down) / (2 * step) - grads[name].ravel()[i]) < 2e-3 * max(1, abs(grads[name].ravel()[i]))


def test_document_probabilities_equal_a_plain_loop():
    w, _, rng = small(1)
    texts = [rng.integers(0, 256, n).astype(np.uint8) for n in (0, 1, 7, 16, 40)]
    data, offsets = np.concatenate(texts), np.cumsum([0] + [len(t) for t in texts])
    got = lang.document_probabilities(w, data, offsets, segment=16)

    def states(d, bytes_):
        h, out = np.zeros(4), []
        for b in bytes_:
            a, u = w["table_" + d][:, b], w["turn_" + d] @ h
            r, z = 1 / (1 + np.exp(-(a[:4] + u[:4]))), 1 / (1 + np.exp(-(a[4:8] + u[4:8])))
            n = np.tanh(a[8:] + r * u[8:])
            h = n + z * (h - n)
            out.append(h)
        return out

    for i, t in enumerate(texts):
        ps = []
        for k in range(0, len(t), 16):
            part = t[k : k + 16]
            f, b = states("f", part), states("b", part[::-1])[::-1]
            for x, y in zip(f, b):
                s = w["out_f"] @ x + w["out_b"] @ y + w["bias"][:, 0]
                ps.append(np.exp(s) / np.exp(s).sum())
        assert np.allclose(got[i], np.mean(ps, axis=0) if ps else 0, atol=1e-5)


def test_held_out_languages_are_found(spark):
    rng = np.random.default_rng(5)
    words = {"aa": ["the", "of", "and", "that", "with"], "bb": ["der", "und", "nicht", "schön", "über"], "cc": ["le", "été", "vous", "que", "eaux"]}
    rows = [(i, " ".join(rng.choice(words[k], rng.integers(3, 60))), k, "x", "y") for i, k in enumerate(rng.choice(list(words), 300).tolist())]
    rows += [(900, None, "aa", "x", "y"), (901, "", "aa", "x", "y"), (902, "12 345 !", "bb", "x", "y"), (903, rows[0][1], None, "x", "y"), (None, "der und", "bb", "x", "y"), (0, rows[0][1], rows[0][2], "x", "y"), (904, "der und " * 40000, "bb", "x", "y")]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = lang.predict_language(docs, F.col("doc_id") % 4 != 2, per_language=80).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    pred = {r.doc_id: r.lang_pred for r in got}
    assert [pred[k] for k in (900, 901, 902)] == ["und"] * 3 and pred[None] == "bb" and pred[904] == "bb"
    held = [(pred[i], k) for i, _, k, _, _ in rows[:300] if i % 4 == 2]
    assert np.mean([a == b for a, b in held]) > 0.95


def test_nothing_to_learn_and_no_rows(spark):
    docs = spark.createDataFrame([(1, "text", None, "x", "y")], SCHEMA)
    assert [tuple(r) for r in lang.predict_language(docs, F.lit(True)).collect()] == [(1, "und", 0.0)]
    assert lang.predict_language(docs.limit(0), F.lit(True)).count() == 0


def test_training_task_does_not_read_the_corpus(spark, tmp_path):
    folder = str(tmp_path)

    def noted(batches):
        open(os.path.join(folder, f"{TaskContext.get().taskAttemptId()}-{uuid.uuid4().hex}"), "w").close()
        yield from batches

    rows = [(i, "der und" if i % 2 else "the of", "bb" if i % 2 else "aa") for i in range(64)]
    docs = spark.createDataFrame(rows, "id long, text string, lang string").repartition(4, "id").mapInArrow(noted, "id long, text string, lang string")
    names, _ = lang.train_languages(docs, per_language=10)
    assert names == ["aa", "bb"]
    assert max(Counter(f.split("-")[0] for f in os.listdir(folder)).values()) == 1  # partitions read by a task
