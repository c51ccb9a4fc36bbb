"""WARC archives as a chunked record table.

Pages become WARC 1.1 records, one gzip member each, in files below the shared folder. Of pages with equal payloads of
at least ``min_bytes`` the one with the smallest id is a response, the others are revisits that refer to it and
carry no payload. Writing and reading stream: a payload passes in pieces of ``CHUNK`` bytes, and the reader gives
a row per record and chunk number with the digest of the payload up to there, so a record of any size takes the
memory of one chunk. The last row of a record holds its full length and digest, which must equal the digest in
the record's header.

Files get names of their own per task attempt; the manifest names those of the attempts that counted.
"""

from __future__ import annotations

import gzip
import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.storage import materialise, scratch_path
from .files import filesystem, own_name

CHUNK = 1 << 16
MIN_BYTES = 100
#: Compressed bytes after which a task goes on in a new file.
FILE_BYTES = 64 << 20

#: The profile of revisits with an equal payload, a fixed value of the WARC 1.1 format.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def record_types(pages: DataFrame, min_bytes: int = MIN_BYTES, id_column: str = "page_id", url_column: str = "url", payload_column: str = "html") -> DataFrame:
    """(id, url, payload, digest, n_bytes, record_type, refers_to) of every row of ``pages``.

    A null payload is empty. Null ids come last in the choice of the response; of rows with equal id and payload
    one is the response. Other columns are not read.
    """
    payload = F.coalesce(F.col(payload_column), F.lit("")).cast("binary")
    rows = pages.select(F.col(id_column).alias("id"), F.col(url_column).alias("url"), payload.alias("payload"))
    rows = rows.withColumns({"digest": F.sha2("payload", 256), "n_bytes": F.octet_length("payload").cast("long")})
    same = rows.where(F.col("n_bytes") >= min_bytes).groupBy("digest", "id").count()
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "count")).alias("first")
    groups = same.groupBy("digest").agg(first, F.sum("count").alias("rows")).where("rows > 1")
    groups = materialise(groups.select("digest", F.col("first.id").alias("first_id"), F.col("first.count").alias("ties")), "equal-payloads")
    joined = rows.join(groups, "digest", "left")
    is_first = F.col("id").eqNullSafe(F.col("first_id"))
    plain = joined.where(F.coalesce(~(is_first & (F.col("ties") > 1)), F.lit(True)))
    response = F.col("ties").isNull() | is_first
    fields = ["id", "url", "payload", "digest", "n_bytes"]
    out = plain.select(*fields, F.when(response, "response").otherwise("revisit").alias("record_type"), F.when(~response, F.col("first_id")).alias("refers_to"))
    if not groups.where("ties > 1").isEmpty():  # rows with the id and the payload of the response: one of them is it
        tied = joined.where(is_first & (F.col("ties") > 1)).groupBy(*fields).count()
        each = tied.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("count"))))
        turn = each.withColumn("turn", F.row_number().over(Window.partitionBy("digest").orderBy("url", "copy")))
        out = out.union(turn.select(*fields, F.when(F.col("turn") == 1, "response").otherwise("revisit"), F.when(F.col("turn") > 1, F.col("id"))))
    return out


def _header(row: dict, date: str) -> bytes:
    clean = lambda x: re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", str(x))
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {row['n_bytes']}\r\n\r\n"
    revisit = row["record_type"] == "revisit"
    lines = ["WARC/1.1", f"WARC-Type: {row['record_type']}", f"WARC-Record-ID: <urn:page:{clean(row['id'])}>", f"WARC-Date: {date}"]
    if row["url"] is not None:
        lines.append(f"WARC-Target-URI: {clean(row['url'])}")
    if revisit:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:page:{clean(row['refers_to'])}>"]
    size = len(http) + (0 if revisit else row["n_bytes"])
    lines += [f"WARC-Payload-Digest: sha256:{row['digest']}", "Content-Type: application/http; msgtype=response", f"Content-Length: {size}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + http.encode()


def write_archives(records: DataFrame, folder: str | None = None, date: str = "2024-01-01T00:00:00Z", chunk: int = CHUNK, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Write rows of ``record_types`` as archives and return the manifest: part, file, n_records, n_bytes (compressed)."""
    folder = folder or scratch_path(records.sparkSession, "warc")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, sink, name, n, size = TaskContext.get().partitionId(), None, "", 0, 0

        def done():
            sink.close()
            return pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "file": [name], "n_records": [n], "n_bytes": [size]})

        for batch in batches:
            payloads = batch.column("payload")
            for i, row in enumerate(batch.select(["id", "url", "digest", "n_bytes", "record_type", "refers_to"]).to_pylist()):
                if sink is None:
                    name, n, size = own_name(folder, part, ".warc.gz"), 0, 0
                    system, place = filesystem(name)
                    system.create_dir(place.rsplit("/", 1)[0], recursive=True)
                    sink = system.open_output_stream(place, compression=None)
                squeeze = zlib.compressobj(5, zlib.DEFLATED, 31)
                pieces = [squeeze.compress(_header(row, date))]
                if row["record_type"] == "response":
                    view = memoryview(payloads[i].as_buffer())
                    for at in range(0, len(view), chunk):
                        pieces.append(squeeze.compress(view[at : at + chunk]))
                        if len(pieces) > 16:
                            size += sink.write(b"".join(pieces))
                            pieces = []
                pieces += [squeeze.compress(b"\r\n\r\n"), squeeze.flush()]
                size += sink.write(b"".join(pieces))
                n += 1
                if size >= file_bytes:
                    yield done()
                    sink = None
        if sink is not None:
            yield done()

    return materialise(records.mapInArrow(run, "part int, file string, n_records long, n_bytes long"), "warc-manifest")


def read_records(source) -> Iterator[tuple[dict[str, str], int, object]]:
    """(headers, payload bytes that follow, stream) of every record; the caller reads the payload from the stream."""
    with gzip.GzipFile(fileobj=source) as stream:
        while line := stream.readline():
            if not line.strip():
                continue
            if not line.startswith(b"WARC/"):
                raise ValueError(f"not a WARC record: {line[:40]!r}")
            headers: dict[str, str] = {}
            while (line := stream.readline().strip()) or False:
                key, _, value = line.decode().partition(":")
                headers[key.lower()] = value.strip()
            left = int(headers["content-length"])
            if headers.get("content-type", "").startswith("application/http"):
                while (line := stream.readline()).strip():
                    left -= len(line)
                    key, _, value = line.decode().partition(":")
                    headers["http-" + key.lower()] = value.strip()
                left -= len(line)
            yield headers, left, stream


def _page(urn: str | None) -> str | None:
    inside = re.fullmatch(r"<urn:page:(.*)>", urn or "")
    return inside[1] if inside and inside[1] != "None" else None


FIELDS = "page string, record_type string, refers_to string, chunk_no int, data binary, payload_bytes long, payload_digest string, last boolean"


def read_chunks(manifest: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """The chunk table of a manifest: page, record_type, refers_to, chunk_no, data, payload_bytes, payload_digest, last.

    payload_bytes and payload_digest (SHA-256, lower-case hex) cover the payload up to and with this chunk. A record
    with an empty payload has one row without data; so has a revisit, with length and digest from its headers.
    """

    def rows_of(place: str) -> Iterator[tuple]:
        system, path = filesystem(place)
        with system.open_input_file(path) as source:
            for headers, left, stream in read_records(source):
                who = _page(headers["warc-record-id"]), headers["warc-type"], _page(headers.get("warc-refers-to"))
                stated = headers["warc-payload-digest"].removeprefix("sha256:")
                if who[1] == "revisit":
                    yield *who, 0, b"", int(headers["http-content-length"]), stated, True
                    continue
                digest, size, number = hashlib.sha256(), 0, 0
                while True:
                    data = stream.read(min(chunk, left))
                    left, size = left - len(data), size + len(data)
                    digest.update(data)
                    last = left == 0
                    if not last and not data:
                        raise ValueError(f"{place} ends inside a record")
                    if last and digest.hexdigest() != stated:
                        raise ValueError(f"payload of {who[0]} differs from its digest")
                    yield *who, number, data, size, digest.hexdigest(), last
                    number += 1
                    if last:
                        break

    names = [x.split()[0] for x in FIELDS.split(", ")]
    types = [pa.string(), pa.string(), pa.string(), pa.int32(), pa.binary(), pa.int64(), pa.string(), pa.bool_()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def out():
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), types)], names)

        for batch in batches:
            for place in batch.column("file").to_pylist():
                for row in rows_of(place):
                    held.append(row)
                    if len(held) >= 256:
                        yield out()
                        held.clear()
        if held:
            yield out()

    numbered = manifest.select("file", F.row_number().over(Window.orderBy("file")).alias("k"))  # a row per file
    return numbered.repartitionById(max(1, manifest.count()), F.col("k") - 1).select("file").mapInArrow(run, FIELDS)
