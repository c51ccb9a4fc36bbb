"""Language of texts by a bidirectional gated recurrent network over bytes, in numpy.

The network reads segments of ``SEGMENT`` bytes in both directions, labels every position with a probability per
language, and a document's probabilities are the mean over all its positions; no byte of a text is left out. It
learns by backpropagation through time from a bounded sample: about ``per_language`` documents of each
language, chosen by a hash of text and id, and ``windows`` windows of each, placed by a hash too. The sample, not the
corpus, meets in the one task that trains; the weights (a few thousand numbers) then travel with the tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .texts import as_text, raw, text_slices

SEGMENT = 96
HIDDEN = 8
#: Segments labelled at once.
LANES = 2048
#: Bounds of the training sample.
PER_LANGUAGE = 600
WINDOWS = 4

Weights = dict[str, np.ndarray]


def new_weights(languages: int, hidden: int, rng: np.random.Generator) -> Weights:
    w: Weights = {}
    for d in "fb":
        w["table_" + d] = rng.normal(0, 0.3, (3 * hidden, 256)).astype(np.float32)
        w["turn_" + d] = rng.normal(0, hidden**-0.5, (3 * hidden, hidden)).astype(np.float32)
        w["out_" + d] = rng.normal(0, hidden**-0.5, (languages, hidden)).astype(np.float32)
    w["bias"] = np.zeros((languages, 1), np.float32)
    return w


def sigmoid(x: np.ndarray) -> np.ndarray:
    np.negative(x, out=x)
    np.exp(x, out=x)
    x += 1
    return np.reciprocal(x, out=x)


def scan(w: Weights, d: str, symbols: np.ndarray, active: np.ndarray, keep: list | None = None) -> np.ndarray:
    """States (steps, hidden, lanes) of one direction; ``active[t]`` lanes, the first ones, have a byte at step t."""
    table, turn = w["table_" + d], w["turn_" + d]
    hidden, lanes = turn.shape[1], symbols.shape[1]
    out = np.zeros((len(symbols), hidden, lanes), np.float32)
    h = np.zeros((hidden, lanes), np.float32)
    for t in range(len(symbols)):
        n = active[t]
        if not n:
            break
        before = h[:, :n]
        a = table.take(symbols[t, :n], axis=1)
        u = turn @ before
        gates = sigmoid(a[: 2 * hidden] + u[: 2 * hidden])
        reset, stay = gates[:hidden], gates[hidden:]
        new = np.tanh(a[2 * hidden :] + reset * u[2 * hidden :])
        after = new + stay * (before - new)
        if keep is not None:
            keep.append((before, u[2 * hidden :], reset, stay, new))
        out[t, :, :n] = after
        h = after
    return out


def scan_back(w: Weights, d: str, symbols: np.ndarray, active: np.ndarray, keep: list, grads: np.ndarray) -> Weights:
    """Gradients of one direction from those of its states: backpropagation through time."""
    turn = w["turn_" + d]
    hidden = turn.shape[1]
    g_table, g_turn = np.zeros((256, 3 * hidden), np.float32), np.zeros_like(turn)
    later = np.zeros((hidden, 0), np.float32)
    for t in range(len(keep) - 1, -1, -1):
        before, u_new, reset, stay, new = keep[t]
        g = grads[t, :, : active[t]].copy()
        g[:, : later.shape[1]] += later
        p_new = g * (1 - stay) * (1 - new * new)
        p_stay = g * (before - new) * stay * (1 - stay)
        p_reset = p_new * u_new * reset * (1 - reset)
        into = np.concatenate([p_reset, p_stay, p_new])
        around = np.concatenate([p_reset, p_stay, p_new * reset])
        np.add.at(g_table, symbols[t, : active[t]], into.T)
        g_turn += around @ before.T
        later = g * stay + turn.T @ around
    return {"table_" + d: g_table.T, "turn_" + d: g_turn}


class Lanes:
    """Segments as lanes, longest first: bytes forward and backward, and how many lanes have a byte at each step."""

    def __init__(self, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray):
        self.order = np.argsort(-sizes, kind="stable")
        starts, self.sizes = starts[self.order], sizes[self.order]
        steps = np.arange(int(self.sizes[0]) if len(sizes) else 0)[:, None]
        top = max(len(data) - 1, 0)
        self.forward = data[np.minimum(starts + steps, top)]
        self.backward = data[np.clip(starts + self.sizes - 1 - steps, 0, top)]
        self.active = (self.sizes[None, :] > steps).sum(axis=1)
        self.turned = np.maximum(self.sizes[None, :] - 1 - steps, 0)  # place of a step in the other direction

    def turn(self, x: np.ndarray) -> np.ndarray:
        """(steps, k, lanes) values of one direction at the other direction's steps."""
        full = int((self.sizes == len(x)).sum())
        out = np.empty_like(x)
        out[:, :, :full] = x[::-1, :, :full]
        if full < x.shape[2]:
            out[:, :, full:] = np.take_along_axis(x[:, :, full:], self.turned[:, None, full:], axis=0)
        return out


def position_probabilities(w: Weights, lanes: Lanes, keep: tuple[list, list] | None = None):
    """(steps, languages, lanes) probabilities at every position, and the states of both directions."""
    f = scan(w, "f", lanes.forward, lanes.active, keep and keep[0])
    b = scan(w, "b", lanes.backward, lanes.active, keep and keep[1])
    score = w["out_f"] @ f + lanes.turn(w["out_b"] @ b) + w["bias"]
    score -= score.max(axis=1, keepdims=True)
    np.exp(score, out=score)
    score /= score.sum(axis=1, keepdims=True)
    return score, f, b


def loss_gradients(w: Weights, lanes: Lanes, label: np.ndarray) -> tuple[float, Weights]:
    """Mean cross-entropy over all positions (``label`` per lane, in lane order) and its gradients."""
    keep: tuple[list, list] = ([], [])
    p, f, b = position_probabilities(w, lanes, keep)
    here = (np.arange(len(p))[:, None] < lanes.sizes[None, :]).astype(np.float32)
    total = here.sum()
    lane = np.arange(len(label))
    loss = float(-(np.log(p[:, label, lane] + 1e-9) * here).sum() / total)
    g = p * here[:, None, :]
    g[:, label, lane] -= here
    g /= total
    turned = lanes.turn(g) * here[:, None, :]
    grads = {"bias": g.sum(axis=(0, 2))[:, None], "out_f": np.einsum("tkn,thn->kh", g, f, optimize=True), "out_b": np.einsum("tkn,thn->kh", turned, b, optimize=True)}
    grads |= scan_back(w, "f", lanes.forward, lanes.active, keep[0], w["out_f"].T @ g)
    grads |= scan_back(w, "b", lanes.backward, lanes.active, keep[1], w["out_b"].T @ turned)
    return loss, grads


def train_network(samples: list[bytes], label: np.ndarray, languages: int, hidden: int = HIDDEN, rounds: int = 8, batch: int = 128, rate: float = 0.02, seed: int = 7) -> Weights:
    """Weights learned from labelled windows, with balanced languages and adaptive steps."""
    rng = np.random.default_rng(seed)
    w = new_weights(languages, hidden, rng)
    first, second = ({k: np.zeros_like(v) for k, v in w.items()} for _ in range(2))
    sizes = np.array([len(s) for s in samples])
    data, starts = np.frombuffer(b"".join(samples), np.uint8), np.cumsum(sizes) - sizes
    groups = [np.flatnonzero(label == k) for k in range(languages)]
    each = max(len(g) for g in groups)
    step, steps = 0, rounds * -(-each * languages // batch)
    for _ in range(rounds):
        order = rng.permutation(np.concatenate([np.resize(rng.permutation(g), each) for g in groups]))
        for i in range(0, len(order), batch):
            some = order[i : i + batch]
            lanes = Lanes(data, starts[some], sizes[some])
            _, grads = loss_gradients(w, lanes, label[some][lanes.order])
            step += 1
            pace = rate * (1 - step / (steps + 1))
            norm = np.sqrt(sum(float((g * g).sum()) for g in grads.values()))
            for k, g in grads.items():
                g = g * min(1.0, 1.0 / (norm + 1e-9))
                first[k] += 0.1 * (g - first[k])
                second[k] += 0.01 * (g * g - second[k])
                w[k] -= pace * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-8)
    return w


def document_probabilities(w: Weights, data: np.ndarray, offsets: np.ndarray, segment: int = SEGMENT) -> np.ndarray:
    """(documents, languages): mean over the positions of each document; zeros without any."""
    size = np.diff(offsets)
    parts = -(-size // segment)
    doc = np.repeat(np.arange(len(size)), parts)
    number = np.arange(len(doc)) - np.repeat(np.cumsum(parts) - parts, parts)
    starts = offsets[:-1][doc] + number * segment
    sizes = np.minimum(segment, offsets[1:][doc] - starts)
    out = np.zeros((len(size), len(w["bias"])))
    for i in range(0, len(doc), LANES):
        lanes = Lanes(data, starts[i : i + LANES], sizes[i : i + LANES])
        p, _, _ = position_probabilities(w, lanes)
        here = np.arange(len(p))[:, None] < lanes.sizes[None, :]
        np.add.at(out, doc[i : i + LANES][lanes.order], np.einsum("tkn,tn->nk", p, here, optimize=True))
    return out / np.maximum(size, 1)[:, None]


def sample_windows(docs: DataFrame, per_language: int, windows: int, segment: int) -> DataFrame:
    """(lang, window) of a bounded, hash-chosen sample of labelled ``docs`` (id, text, lang)."""
    known = docs.where("lang is not null and text is not null").where(F.col("text").rlike(r"\p{L}"))
    counts = known.groupBy("lang").count()
    mixed = F.xxhash64("text", F.col("id"))
    share = F.lit(float(per_language)) / F.col("count") * F.lit(float(1 << 30))
    chosen = known.join(F.broadcast(counts), "lang").where(F.pmod(mixed, F.lit(1 << 30)) < share)  # a row per language

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lang, out = [], []
            for i, text in enumerate(as_text(batch.column(1)).to_pylist()):
                data = text.encode()
                places = np.random.default_rng(abs(batch.column(2)[i].as_py())).integers(0, max(1, len(data) - segment + 1), windows)
                for at in sorted(set(places.tolist())):
                    lang.append(i), out.append(data[at : at + segment])
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(lang, pa.int64())), pa.array(out, pa.binary())], ["lang", "window"])

    return chosen.select("lang", "text", mixed.alias("mixed")).mapInArrow(cut, "lang string, window binary")


def train_languages(docs: DataFrame, per_language: int = PER_LANGUAGE, windows: int = WINDOWS, segment: int = SEGMENT, hidden: int = HIDDEN) -> tuple[list[str], Weights]:
    """(languages, weights) learned from ``docs`` (id, text, lang); no labelled text: no languages."""
    sample = sample_windows(docs, per_language, windows, segment)

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted((x, y) for b in batches for x, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist()))
        names = sorted({x for x, _ in rows})
        if names:
            w = train_network([y for _, y in rows], np.array([names.index(x) for x, _ in rows]), len(names), hidden)
            for k, v in w.items():
                yield pa.RecordBatch.from_pydict({"name": [k], "shape": [list(v.shape)], "weights": pa.array([v.astype("<f4").tobytes()], pa.binary()), "languages": [names]})

    found = sample.repartition(1).mapInArrow(learn, "name string, shape array<long>, weights binary, languages array<string>").collect()
    weights = {r.name: np.frombuffer(r.weights, "<f4").reshape(r.shape).astype(np.float32) for r in found}
    return (list(found[0].languages) if found else []), weights


def predict_language(docs: DataFrame, train_on, per_language: int = PER_LANGUAGE, id_column: str = "doc_id", text_column: str = "text", lang_column: str = "lang", hidden: int = HIDDEN, keep: tuple[str, ...] = ()) -> DataFrame:
    """(id, lang_pred, score) of every row of ``docs``, and its columns ``keep``.

    The network learns from text and non-null language of rows where ``train_on`` is true (null: not) and predicts
    from the text alone. lang_pred is ``und`` with score 0 where the text is null or has no letter, or where
    nothing could be learned. score is the mean probability of the predicted language over all bytes. Repeated ids
    and rows stay separate rows; null ids are kept; other columns are not read. Very long texts are labelled whole, byte by byte.
    """
    known = docs.where(F.coalesce(train_on, F.lit(False))).select(F.col(id_column).alias("id"), F.col(text_column).alias("text"), F.col(lang_column).alias("lang"))
    languages, weights = train_languages(known, per_language, hidden=hidden)
    has_letter = F.col(text_column).rlike(r"\p{L}")

    def label(text: pa.Array) -> pa.Array:
        text = as_text(text)
        found, score = [], []
        for a, b in text_slices(text):
            data, offsets = raw(text.slice(a, b - a))
            p = document_probabilities(weights, data, offsets) if languages else np.zeros((b - a, 1))
            empty = (np.diff(offsets) == 0) | (not languages)
            found += ["und" if e else languages[k] for e, k in zip(empty, p.argmax(axis=1))]
            score.append(np.where(empty, 0.0, np.clip(p.max(axis=1), 0, 1)))
        return pa.StructArray.from_arrays([pa.array(found, pa.string()), pa.array(np.concatenate(score or [np.zeros(0)]))], ["lang_pred", "score"])

    # only texts go to Python and only labels come back; not deterministic, so that no filter computes it again
    labelled = F.arrow_udf(label, "lang_pred string, score double").asNondeterministic()
    found = docs.select(*(F.col(c) for c in (id_column, *keep)), labelled(F.when(has_letter, F.col(text_column))).alias("__found"))
    return found.select(id_column, *keep, F.col("__found.lang_pred").alias("lang_pred"), F.col("__found.score").alias("score"))
