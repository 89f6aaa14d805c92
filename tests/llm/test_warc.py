import gzip
import hashlib
import json
import zlib

import pytest

from logloom.llm import warc
from logloom.llm.files import opened
from logloom.session import scratch_path

BIG = "<p>" + "x" * 1200 + "</p>"
PAGES = [
    (1, "http://a.org/1", BIG, "x"),
    (2, "http://a.org/2\r\nX: y", BIG, "x"),
    (3, None, BIG, "x"),
    (4, "http://a.org/4", None, "x"),
    (5, "http://a.org/5", "", "x"),
    (6, "http://a.org/6", "short", "x"),
    (7, "http://a.org/7", "short", "x"),
    (8, "u", "é" * 500 + "\r\n\r\nWARC/1.1\r\n\r\n", "x"),
    (9, "u", "é" * 500 + "\r\n\r\nWARC/1.1\r\n\r\n", "x"),
    (9, "u", "é" * 500 + "\r\n\r\nWARC/1.1\r\n\r\n", "x"),
    (None, "u", BIG, "x"),
    (10, "u", "long " * 500_000, "x"),
]


def pages(spark, rows=PAGES):
    return spark.createDataFrame(rows, "page_id long, url string, html string, digest string")


def test_round_trip(spark):
    folder = scratch_path(spark, "warc-test")
    members, found = warc.archived(pages(spark), folder)
    rows = found.collect()
    assert len(rows) == len(PAGES)
    for page_id, url, html, _ in PAGES:
        payload = (html or "").encode()
        same = [p for p, _, h, _ in PAGES if (h or "").encode() == payload and p is not None]
        original = max(same) if len(payload) >= 1000 else page_id
        for row in (r for r in rows if r["page_id"] == page_id and r["payload_bytes"] == len(payload)):
            assert row["payload_digest"] == hashlib.sha1(payload).hexdigest()
            assert row["record_type"] == ("response" if page_id == original else "revisit")
            assert row["refers_to"] == (None if page_id == original else original)
            assert row["payload"] == (payload if page_id == original else None)
    # Each record is a member of its own, and the whole is one valid gzip file.
    for path in (r["archive"] for r in members.collect()):
        with opened(path) as file, opened(f"{path}.idx") as index:
            whole = file.read()
            entries = [json.loads(x) for x in index.read().splitlines()]
        parts = [zlib.decompress(whole[e["offset"] : e["offset"] + e["length"]], warc.GZIP) for e in entries]
        assert all(p.startswith(b"WARC/1.1\r\n") and p.endswith(b"\r\n\r\n") for p in parts)
        assert gzip.decompress(whole) == b"".join(parts)


@pytest.mark.parametrize("size", [1, 7, 64, 100_000])
def test_records_come_whole_from_pieces(size):
    records = [warc.record(n, "u", html, None) for n, html in enumerate(["", "a\r\n\r\nb", BIG, None])]
    one = zlib.compressobj(6, zlib.DEFLATED, warc.GZIP)
    data = b"".join(map(one.compress, records[:2])) + one.flush()
    data += b"".join(gzip.compress(r) for r in records[2:])
    found = warc.Records()
    pieces = (data[n : n + size] for n in range(0, len(data), size))
    assert [r for piece in warc.inflated(pieces) for r in found.feed(piece)] == records
    assert not found.rest


def test_empty_table(spark):
    _, found = warc.archived(pages(spark, []), scratch_path(spark, "warc-test"))
    assert found.collect() == []
