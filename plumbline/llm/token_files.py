"""Token ids in Arrow files of equal-length sequences.

Documents in ascending id order form one stream of ids. Each task writes its range of that stream as an
Arrow IPC file whose record batches hold ``ids`` and ``mask``, fixed-size lists of ``length`` values
(the mask is false on the padding that ends a file), and a small index file with a row per document.
All batches but the last have ``ROWS`` sequences, so sequence i of a file is row i % ROWS of batch
i // ROWS: a reader maps the file and gets views of the buffers, nothing is decoded or copied. Ids take
two bytes where the vocabulary allows it.

Files get names of their own per task attempt; the returned manifest, itself a table in the shared
folder, names those of the attempts that counted.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.storage import materialise, scratch_path
from .encode import encoder
from .files import filesystem, own_name
from .texts import as_text, text_slices

LENGTH = 2048
ROWS = 128


class SequenceWriter:
    """Appends ids to a file of fixed-size-list batches."""

    def __init__(self, path: str, length: int, wide: bool, rows: int = ROWS):
        system, place = filesystem(path)
        system.create_dir(place.rsplit("/", 1)[0], recursive=True)
        kind = pa.uint32() if wide else pa.uint16()
        self.length, self.rows, self.dtype = length, rows, np.dtype("<u4" if wide else "<u2")
        self.schema = pa.schema([("ids", pa.list_(kind, length)), ("mask", pa.list_(pa.bool_(), length))])
        self.sink = system.open_output_stream(place)
        self.file = pa.ipc.new_file(self.sink, self.schema)
        self.open, self.n_open, self.n_sequences = [], 0, 0

    def add(self, ids: np.ndarray) -> None:
        self.open.append(ids.astype(self.dtype))
        self.n_open += len(ids)
        if self.n_open >= self.rows * self.length:
            self._write(False)

    def _write(self, last: bool) -> None:
        ids = np.concatenate(self.open) if self.open else np.zeros(0, self.dtype)
        step = self.rows * self.length
        for i in range(0, len(ids) if last else len(ids) - step + 1, step):
            part = ids[i : i + step]
            n = -(-len(part) // self.length)
            mask = np.ones(n * self.length, bool)
            mask[len(part) :] = False
            part = np.concatenate([part, np.zeros(n * self.length - len(part), self.dtype)])
            columns = [pa.FixedSizeListArray.from_arrays(pa.array(x), self.length) for x in (part, mask)]
            self.file.write_batch(pa.RecordBatch.from_arrays(columns, schema=self.schema))
            self.n_sequences += n
        rest = ids[len(ids) - len(ids) % step :]
        self.open, self.n_open = ([] if last else [rest]), 0 if last else len(rest)

    def close(self) -> None:
        self._write(True)
        self.file.close()
        self.sink.close()


class SequenceReader:
    """Random access to the sequences of one file, as views of its buffers."""

    def __init__(self, path: str):
        system, place = filesystem(path)
        local = system.type_name == "local"
        self.source = pa.memory_map(place) if local else system.open_input_file(place)
        self.file = pa.ipc.open_file(self.source)
        self.length = self.file.schema.field("ids").type.list_size
        self.first_rows = self.file.get_batch(0).num_rows if self.file.num_record_batches else 1

    def batch_ids(self, k: int) -> np.ndarray:
        """The ids of batch ``k`` without its padding."""
        batch = self.file.get_batch(k)
        ids = batch.column(0).flatten().to_numpy(zero_copy_only=True)
        if k < self.file.num_record_batches - 1:
            return ids
        return ids[: batch.column(1).flatten().true_count]

    def sequence(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids, mask) of sequence ``i``; the ids are a view."""
        batch, row = self.file.get_batch(i // self.first_rows), i % self.first_rows
        at = slice(row * self.length, (row + 1) * self.length)
        return batch.column(0).flatten().to_numpy(zero_copy_only=True)[at], batch.column(1).flatten()[at].to_numpy(zero_copy_only=False)


def write_token_files(
    docs: DataFrame, tokenizer_path: str, space: str, end_id: int, folder: str | None = None,
    length: int = LENGTH, id_column: str = "doc_id", text_column: str = "text",
) -> DataFrame:
    """Write ``docs`` as token files and return the manifest: part, file, index, n_docs, n_tokens, n_sequences, start.

    A null or empty text has the end id only. Rows with equal ids keep an order by a hash of the text and the
    text; null ids come first. An empty table gives an empty manifest. Other columns are not read.
    ``start`` counts the ids of all earlier files.
    """
    spark = docs.sparkSession
    folder = folder or scratch_path(spark, "token-files")
    kind = docs.schema[id_column].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer_path, space)
        wide = enc.tokenizer.get_vocab_size() > 1 << 16 or end_id >= 1 << 16
        end = np.array([end_id], "<u4").tobytes()
        part = TaskContext.get().partitionId()
        writer = listing = sink = None
        name = index = ""
        n_docs = n_tokens = 0
        for batch in batches:
            text = as_text(batch.column(1))
            for a, b in text_slices(text):
                if writer is None:
                    name, index = own_name(folder, part, ".arrow"), own_name(folder, part, ".index.arrow")
                    writer = SequenceWriter(name, length, wide)
                    system, place = filesystem(index)
                    sink = system.open_output_stream(place)
                    listing = pa.ipc.new_file(sink, pa.schema([("id", batch.schema.field(0).type), ("n_tokens", pa.int64())]))
                coded = [x + end for x in enc.encode(text.slice(a, b - a))]
                sizes = [len(x) // 4 for x in coded]
                writer.add(np.frombuffer(b"".join(coded), "<u4"))
                listing.write_batch(pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(sizes, pa.int64())], schema=listing_schema(batch)))
                n_docs, n_tokens = n_docs + b - a, n_tokens + sum(sizes)
        if writer is not None:
            writer.close(), listing.close(), sink.close()
            yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "file": [name], "index": [index], "n_docs": [n_docs], "n_tokens": [n_tokens], "n_sequences": [writer.n_sequences]})

    plain = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"))
    tie = F.xxhash64("text")
    ordered = plain.repartitionByRange("id", tie).sortWithinPartitions("id", tie, "text")
    written = ordered.mapInArrow(run, "part int, file string, index string, n_docs long, n_tokens long, n_sequences long")
    manifest = materialise(written, "token-manifest")
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row per file
    return manifest.withColumns({"start": F.coalesce(F.sum("n_tokens").over(earlier), F.lit(0).cast("long")), "id_type": F.lit(kind)})


def listing_schema(batch: pa.RecordBatch) -> pa.Schema:
    return pa.schema([("id", batch.schema.field(0).type), ("n_tokens", pa.int64())])


def documents_of(reader: SequenceReader, listing: pa.Table, start: int, some: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """(id, start, ids as little-endian unsigned 32-bit bytes) of a file's documents, about ``some`` ids at a time."""
    sizes = listing.column(1).to_numpy()
    stops = np.cumsum(sizes)
    have, base, k, row = np.zeros(0, "<u4"), 0, 0, 0  # ids from position ``base`` on
    while row < len(sizes):
        upto = max(row + 1, int(np.searchsorted(stops, base + some, side="right")))
        first = stops[row] - sizes[row]
        blocks = [have[first - base :]]
        got = first + len(blocks[0])
        while got < stops[upto - 1]:
            ids = reader.batch_ids(k).astype("<u4")
            k += 1
            skip = max(0, first - got)
            blocks.append(ids[skip:])
            got += len(ids)
        have, base = np.concatenate(blocks), first
        data = have[: stops[upto - 1] - base].tobytes()
        cuts = np.concatenate([[0], (stops[row:upto] - base) * 4]).astype(np.int64)
        ids = pa.Array.from_buffers(pa.large_binary(), upto - row, [None, pa.py_buffer(cuts.tobytes()), pa.py_buffer(data)]).cast(pa.binary())
        begins = pa.array(start + stops[row:upto] - sizes[row:upto], pa.int64())
        yield pa.RecordBatch.from_arrays([listing.column(0).slice(row, upto - row).combine_chunks(), begins, ids], ["id", "start", "ids"])
        row = upto


def read_token_files(manifest: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """(id, start, ids) of every document, read back from the files of a manifest; ids as bytes.

    The type of the id is the one it was written with.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                system, place = filesystem(row["index"])
                with system.open_input_file(place) as source:
                    listing = pa.ipc.open_file(source).read_all()
                yield from documents_of(SequenceReader(row["file"]), listing, row["start"])

    n, id_type = manifest.agg(F.max("part"), F.coalesce(F.max("id_type"), F.lit("bigint"))).first()
    spread = manifest.select("part", "file", "index", "start").repartitionById((n or 0) + 1, F.col("part"))
    return spread.mapInArrow(run, f"id {id_type}, start long, ids binary").withColumnRenamed("id", id_column)
