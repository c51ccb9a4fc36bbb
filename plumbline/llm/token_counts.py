"""Token counts: Arrow batches go in, only lengths come out.

Texts are cut at safe boundaries into pieces of about ``PIECE_CHARS``, pieces are grouped into calls of
about ``CALL_BYTES``, and a task gives back one number per text. A boundary is a space that follows a
character other than a space: no vocabulary entry of a sentencepiece BPE model holds a word mark after
another character (checked when the model is loaded), and the next piece gets that mark back as its
leading one, so the counts of the pieces add up to the count of the text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .texts import as_text

PIECE_CHARS = 16_384
CALL_BYTES = 1 << 19

_MARK = "▁"
_BOUNDARY = re.compile(f"(?<=[^ {_MARK}]) (?=.)", re.S)
_COUNTERS: dict = {}


class PieceCounter:
    """Counts of whole texts by a sentencepiece BPE model file."""

    def __init__(self, path: str, piece_chars: int = PIECE_CHARS):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        entries = (self.model.id_to_piece(i) for i in range(self.model.get_piece_size()))
        self.can_cut = not any(re.search(f"[^{_MARK}]{_MARK}", e) for e in entries)
        self.piece_chars = piece_chars

    def pieces(self, text: str) -> list[str]:
        if len(text) <= self.piece_chars or not self.can_cut:
            return [text]
        out, start = [], 0
        while len(text) - start > self.piece_chars:
            found = _BOUNDARY.search(text, start + self.piece_chars)
            if found is None:
                break
            out.append(text[start : found.start()])
            start = found.end()
        return [*out, text[start:]]

    def counts(self, texts: list[str]) -> np.ndarray:
        out = np.zeros(len(texts), np.int64)
        rows: list[int] = []
        call: list[str] = []
        size = 0

        def flush():
            np.add.at(out, rows, [len(x) for x in self.model.encode(call, num_threads=1)])
            rows.clear(), call.clear()

        for i, text in enumerate(texts):
            for piece in self.pieces(text):
                rows.append(i), call.append(piece)
                size += len(piece)
                if size >= CALL_BYTES:
                    flush()
                    size = 0
        if call:
            flush()
        return out


def _counter(path: str) -> PieceCounter:
    if path not in _COUNTERS:
        _COUNTERS[path] = PieceCounter(path)
    return _COUNTERS[path]


def count_tokens(docs: DataFrame, model_path: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, n_bytes, n_tokens) of every row of ``docs``.

    A null or empty text has 0 bytes and 0 tokens. Repeated rows and ids stay separate rows. Other
    columns of ``docs`` are not read, so their names cannot clash; a null id stays null.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(model_path)
        for batch in batches:
            text = as_text(batch.column(1))
            size = pc.binary_length(text).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), size, pa.array(counter.counts(text.to_pylist()))], ["id", "n_bytes", "n_tokens"])

    kind = docs.schema[id_column].dataType.simpleString()
    plain = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"))
    return plain.mapInArrow(run, f"id {kind}, n_bytes long, n_tokens long").withColumnRenamed("id", id_column)
