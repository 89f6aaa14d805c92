"""Operator 10: WARC archives from pages, and a normaliser of monolithic gzip.

``write_archives`` writes a page a record. Each task streams its records into one gzip stream, as a
crawler's whole-file compression would. ``normalise`` then inflates each such file once, front to back,
writes every record as a gzip member of its own, and adds a sidecar index: page id, offset, length and
record id of each member. ``read_archives`` seeks to members by that index.

Of pages with equal payloads of ``min_duplicate`` bytes or more, the one with the largest page_id is a
response and the others are revisits of it that hold no payload; rows that share the largest page_id
are all responses. A null html is an empty payload. A null url becomes an empty target, a null page_id
has no id in the record and is never the original of another page unless all copies lack one (then all
are responses). Control characters of a url are percent-encoded. An empty table makes no archives.
"""

from __future__ import annotations

import base64
import hashlib
import json
import uuid
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from logloom.llm.common import small, stored
from logloom.llm.files import opened, written

MIN_DUPLICATE = 1000
BROADCAST_ROWS = 200_000  # originals are sent to all tasks up to so many, else joined by shuffle
CHUNK = 1 << 20
GZIP = 16 + zlib.MAX_WBITS
DATE = "2024-01-01T00:00:00Z"  # pages carry no capture time
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"  # fixed value
NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # fixed value: RFC 4122's for URLs


def with_originals(pages: DataFrame, min_duplicate: int = MIN_DUPLICATE) -> DataFrame:
    """page_id, url, html and refers_to: the page whose payload a page repeats, else null."""
    spark = pages.sparkSession
    payload = F.encode(F.coalesce(F.col("html"), F.lit("")), "UTF-8")
    rows = pages.select("page_id", "url", "html", F.sha1(payload).alias("digest"), F.length(payload).alias("bytes"))
    shared = (
        rows.where(F.col("bytes") >= min_duplicate)
        .groupBy("digest")
        .agg(F.count("*").alias("n"), F.max("page_id").alias("original"))
        .where("n > 1 and original is not null")
        .select("digest", "original")
    )
    if small(shared, BROADCAST_ROWS):
        shared = F.broadcast(shared)
    repeats = F.col("original").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("original"))
    return rows.join(shared, "digest", "left").select(
        "page_id", "url", "html", F.when(repeats, F.col("original")).alias("refers_to")
    )


def record_id(page_id: int | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(NAMESPACE, f'page:{page_id}')}>"


def record(page_id: int | None, url: str | None, html: str | None, refers_to: int | None) -> bytes:
    """One WARC record. A revisit keeps the HTTP headers, so the size of its payload stays known."""
    payload = (html or "").encode()
    target = "".join(c if " " < c != "\x7f" else f"%{ord(c):02X}" for c in url or "")
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: {record_id(page_id)}",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {target}",
        f"WARC-Payload-Digest: sha1:{digest}",
        "Content-Type: application/http; msgtype=response",
    ]
    if page_id is not None:
        head.append(f"X-Page-ID: {page_id}")
    if refers_to is not None:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(refers_to)}", f"X-Refers-To-Page: {refers_to}"]
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def fields_of(head: bytes) -> dict[str, str]:
    lines = head.decode().split("\r\n")[1:]
    return {name.lower(): value.strip() for name, _, value in (x.partition(":") for x in lines) if name}


class Records:
    """Records of a decompressed WARC stream, fed in pieces; holds one record and one piece at most."""

    def __init__(self) -> None:
        self.rest = bytearray()
        self.need = 0  # bytes of the record at the front, once its head is known

    def feed(self, piece: bytes) -> Iterator[bytes]:
        self.rest += piece
        start = 0
        while True:
            if not self.need:
                end = self.rest.find(b"\r\n\r\n", start)
                if end < 0:
                    break
                self.need = end - start + 4 + int(fields_of(bytes(self.rest[start:end]))["content-length"]) + 4
            if len(self.rest) - start < self.need:
                break
            yield bytes(self.rest[start : start + self.need])
            start += self.need
            self.need = 0
        del self.rest[:start]


def inflated(pieces: Iterable[bytes]) -> Iterator[bytes]:
    """The content of a gzip file of one or more members, in bounded pieces."""
    stream = zlib.decompressobj(GZIP)
    for piece in pieces:
        while piece:
            yield stream.decompress(piece, CHUNK)
            if stream.eof:
                piece, stream = stream.unused_data, zlib.decompressobj(GZIP)
            else:
                piece = stream.unconsumed_tail
    tail = stream.flush()
    if tail:
        yield tail


def _pieces(file) -> Iterator[bytes]:
    while piece := file.read(CHUNK):
        yield piece


def write_archives(rows: DataFrame, folder: str) -> DataFrame:
    """Files (``archive``, ``records``) of one gzip stream each, from page_id, url, html, refers_to."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path = f"{folder}/monolithic/part-{TaskContext.get().partitionId():06d}.warc.gz"
        first = next((b for b in batches if b.num_rows), None)
        if first is None:
            return
        count, gzip = 0, zlib.compressobj(6, zlib.DEFLATED, GZIP)
        with written(path) as out:
            batch = first
            while batch is not None:
                for row in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "html", "refers_to"))):
                    out.write(gzip.compress(record(*row)))
                    count += 1
                batch = next(batches, None)
            out.write(gzip.flush())
        yield pa.RecordBatch.from_pydict({"archive": [path], "records": [count]})

    return rows.select("page_id", "url", "html", "refers_to").mapInArrow(write, "archive string, records long")


def normalise(archives: DataFrame, folder: str) -> DataFrame:
    """Archives (``archive``) with a member per record, and beside each its index; one row per file."""

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for source in batch.column("archive").to_pylist():
                path = f"{folder}/members/{source.rpartition('/')[2]}"
                offset, count, found = 0, 0, Records()
                with opened(source) as file, written(path) as out, written(f"{path}.idx") as index:
                    for piece in inflated(_pieces(file)):
                        for one in found.feed(piece):
                            head = fields_of(one[: one.index(b"\r\n\r\n")])
                            gzip = zlib.compressobj(6, zlib.DEFLATED, GZIP)
                            member = gzip.compress(one) + gzip.flush()
                            out.write(member)
                            entry = {"offset": offset, "length": len(member), "id": head["warc-record-id"], "page": head.get("x-page-id")}
                            index.write(json.dumps(entry).encode() + b"\n")
                            offset += len(member)
                            count += 1
                    if found.rest.strip():
                        raise ValueError(f"{source} ends within a record")
                yield pa.RecordBatch.from_pydict({"archive": [path], "records": [count]})

    return archives.select("archive").mapInArrow(rewrite, "archive string, records long")


def read_archives(archives: DataFrame) -> DataFrame:
    """A row for each record that the sidecar indexes name, checked against its own digest."""
    schema = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column("archive").to_pylist():
                with opened(f"{path}.idx") as index, opened(path) as file:
                    for line in index.read().splitlines():
                        entry = json.loads(line)
                        file.seek(entry["offset"])
                        yield _row(zlib.decompress(file.read(entry["length"]), GZIP))

    return archives.select("archive").mapInArrow(_batched(read), schema)


def _row(one: bytes) -> dict:
    end = one.index(b"\r\n\r\n")
    head, block = fields_of(one[:end]), one[end + 4 : -4]
    http, _, payload = block.partition(b"\r\n\r\n")
    digest = base64.b32decode(head["warc-payload-digest"].removeprefix("sha1:")).hex()
    revisit = head["warc-type"] == "revisit"
    if not revisit and hashlib.sha1(payload).hexdigest() != digest:
        raise ValueError(f"payload of {head['warc-record-id']} differs from its digest")
    page, original = head.get("x-page-id"), head.get("x-refers-to-page")
    return {
        "page_id": page and int(page),
        "url": head["warc-target-uri"],
        "payload_bytes": int(fields_of(http)["content-length"]),
        "payload_digest": digest,
        "record_type": head["warc-type"],
        "refers_to": original and int(original),
        "payload": None if revisit else payload,
    }


def _batched(rows_of, most_bytes: int = 4 << 20):
    """Rows (dicts) as record batches of a bounded size."""
    kinds = pa.schema(
        [("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, held = [], 0
        for row in rows_of(batches):
            rows.append(row)
            held += 200 + len(row["payload"] or b"")
            if held >= most_bytes:
                yield pa.RecordBatch.from_pylist(rows, kinds)
                rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, kinds)

    return run


def archived(pages: DataFrame, folder: str) -> tuple[DataFrame, DataFrame]:
    """Write, normalise: the files with a member per record, and their rows read back."""
    spark: SparkSession = pages.sparkSession
    plain = stored(write_archives(with_originals(pages), folder), "warc-monolithic")
    members = stored(normalise(_one_each(spark, plain), folder), "warc-members")
    return members, read_archives(_one_each(spark, members))


def _one_each(spark: SparkSession, files: DataFrame) -> DataFrame:
    """Files dealt out over the tasks."""
    count = max(1, files.count())
    return files.repartition(min(count, 10_000), "archive") if count > 1 else files
