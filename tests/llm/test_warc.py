import gzip
import hashlib

import pytest

from plumbline.llm import warc
from plumbline.llm.files import filesystem

SCHEMA = "page_id long, url string, html string, digest string, payload string"


def run(spark, rows, **options):
    frame = spark.createDataFrame([(i, u, h, "x", "y") for i, u, h in rows], SCHEMA).repartition(3)
    manifest = warc.write_archives(warc.record_types(frame), **options)
    return manifest, warc.read_chunks(manifest, chunk=64).collect()


def brute(rows):
    first, out = {}, []
    for i, _, h in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        body = (h or "").encode()
        digest = hashlib.sha256(body).hexdigest()
        page = None if i is None else str(i)
        if len(body) >= 100 and digest in first:
            out.append((page, "revisit", first[digest], len(body), digest))
        else:
            first[digest] = page
            out.append((page, "response", None, len(body), digest))
    return sorted(out, key=str)


ROWS = [(9, "http://a/\r\nX: y", "é" * 60), (3, None, "é" * 60), (5, "u", "é" * 60), (4, "u", "short"), (1, "u", "short"), (6, "u", None), (7, "u", ""), (8, "u", "x" * 100), (2, "u", "x" * 100), (2, "u", "x" * 100), (2, "v", "x" * 100), (None, "u", "x" * 100), (10, "u", "WARC/1.1\r\n\r\n" * 4000)]


def test_records_round_trip_in_chunks(spark):
    manifest, rows = run(spark, ROWS, file_bytes=400)
    assert sorted(((r.page, r.record_type, r.refers_to, r.payload_bytes, r.payload_digest) for r in rows if r.last), key=str) == brute(ROWS)
    long = sorted((r for r in rows if r.page == "10"), key=lambda r: r.chunk_no)
    body = ROWS[-1][2].encode()
    assert [r.chunk_no for r in long] == list(range(len(long))) and b"".join(bytes(r.data) for r in long) == body
    for r in long:
        assert len(r.data) <= 64 and r.payload_digest == hashlib.sha256(body[: r.payload_bytes]).hexdigest()
    assert sum(r.n_records for r in manifest.collect()) == len(ROWS)
    head = gzip.decompress(open(filesystem(manifest.first().file)[1], "rb").read()).split(b"\r\n")
    assert head[0] == b"WARC/1.1" and not any(line.startswith(b"X: y") for line in head)


def test_ties_give_one_response(spark):
    rows = [(1, "u", "z" * 200)] * 5 + [(2, "u", "z" * 200)]
    _, got = run(spark, rows)
    kinds = sorted((r.page, r.record_type, r.refers_to or "") for r in got if r.last)
    assert kinds == [("1", "response", "")] + [("1", "revisit", "1")] * 4 + [("2", "revisit", "1")]


def test_no_rows(spark):
    assert run(spark, [])[1] == []


def test_a_changed_payload_is_found(spark):
    manifest, _ = run(spark, [(1, "u", "payload " * 50)])
    place = filesystem(manifest.first().file)[1]
    data = gzip.decompress(open(place, "rb").read()).replace(b"payload payload", b"payload_payload")
    with open(place, "wb") as f:
        f.write(gzip.compress(data))
    with pytest.raises(Exception, match="differs from its digest"):
        warc.read_chunks(manifest).collect()
