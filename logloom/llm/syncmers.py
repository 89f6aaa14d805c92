"""Operator 6: document fingerprints from closed syncmers.

A k-mer of code points is a closed syncmer if the smallest hash of its inner s-mers is that of the first
or the last one. Whether a k-mer is chosen depends on nothing around it, so a passage keeps its anchors
wherever it stands, and anchors that two texts share give the places where they match.

A fingerprint of density 1 holds all distinct anchors, as the query's do; a thinner one those with hashes in the
first ``density``-th of all, and at least the ``LEAST`` smallest, so either grows with the text. Each anchor stands as
eight hex digits of its hash and eight of its first position (modulo 2^32). ``likeness`` is the part of their distinct anchors that two texts have in common (Dice's
coefficient), of all anchors, not of the fingerprints': 1 for equal texts, 0 where nothing is shared.
``matches`` gives the places of the anchors that two texts share, ``alike`` how many of them lie on the
commonest shift, as in a passage that was moved as a whole.

A text shorter than a k-mer is its own anchor; a longer one without a syncmer has the k-mer of the
smallest hash. Null and empty texts have the empty fingerprint; two empty ones have likeness 1, an empty
and another 0. Whole texts count. ``with_next`` orders rows by doc_id (null first), equal ids by a hash
of the text; the last row is followed by the first, so a single row follows itself. An empty table gives
no rows.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

K, S = 16, 8
DENSITY, LEAST = 16, 16
CHUNK = 1 << 18  # code points of a text that are hashed at once
CHARS_WAITING = 1 << 23  # of fingerprints that are held back to be sent together
ROWS_PER_BUCKET = 5000
MAX_BUCKETS = 20_000
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def _mixed(values: np.ndarray) -> np.ndarray:
    values = values * _MULTIPLIER
    values ^= values >> np.uint64(32)
    values *= np.uint64(0xD6E8FEB86659FD93)
    values ^= values >> np.uint64(29)
    return values


def _smers(points: np.ndarray, size: int) -> np.ndarray:
    """A hash of each run of ``size`` code points."""
    count = len(points) - size + 1
    found = np.zeros(count, np.uint64)
    for n in range(size):
        found = found * _MULTIPLIER + points[n : n + count]
    return _mixed(found)


def _window_min(values: np.ndarray, width: int) -> np.ndarray:
    found, covered = values, 1
    while covered < width:
        step = min(covered, width - covered)
        found = np.minimum(found[:-step], found[step:])
        covered += step
    return found


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), "<u4").astype(np.uint64)


def syncmers(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Positions and 32-bit hashes of the text's anchors."""
    if not text:
        return np.zeros(0, np.int64), np.zeros(0, np.uint32)
    if len(text) < K:
        points = _points(text)
        return np.zeros(1, np.int64), (_smers(points, len(points)) >> np.uint64(32)).astype(np.uint32)
    positions, hashes = [], []
    least: tuple[int, int] | None = None
    for at in range(0, len(text) - K + 1, CHUNK):
        inner = _smers(_points(text[at : at + CHUNK + K - 1]), S)
        width = K - S + 1
        smallest = _window_min(inner, width)
        first, last = inner[: len(smallest)], inner[width - 1 :]
        chosen = np.flatnonzero((first == smallest) | (last == smallest))
        kmers = _mixed(first * np.uint64(3) + last) >> np.uint64(32)
        n = int(kmers.argmin())
        least = min(least or (1 << 32, 0), (int(kmers[n]), at + n))
        positions.append(chosen + at)
        hashes.append(kmers[chosen].astype(np.uint32))
    found, kept = np.concatenate(positions), np.concatenate(hashes)
    if not len(found):
        return np.array([least[1]]), np.array([least[0]], np.uint32)
    return found, kept


def sketch(text: str) -> np.ndarray:
    """Rows of hash and first position of all distinct anchors, in ascending order of hashes."""
    positions, hashes = syncmers(text)
    unique, first = np.unique(hashes, return_index=True)
    return np.stack([unique, positions[first].astype(np.uint32)], 1)


def fingerprint(found: np.ndarray, density: int = DENSITY) -> np.ndarray:
    """The anchors that a fingerprint holds."""
    if density == 1:
        return found
    dense = int(np.searchsorted(found[:, 0], (1 << 32) // density))
    return found[: max(dense, LEAST)]


def written_out(found: np.ndarray) -> str:
    return found.astype(">u4").tobytes().hex()


def parsed(fingerprint: str) -> np.ndarray:
    return np.frombuffer(bytes.fromhex(fingerprint), ">u4").astype(np.uint32).reshape(-1, 2)


def likeness(one: np.ndarray, other: np.ndarray) -> float:
    """The part of their anchors that two texts share."""
    if not len(one) or not len(other):
        return float(len(one) == len(other))
    return 2 * len(np.intersect1d(one[:, 0], other[:, 0], assume_unique=True)) / (len(one) + len(other))


def matches(one: np.ndarray, other: np.ndarray) -> list[tuple[int, int]]:
    """Where two texts have an anchor in common."""
    _, a, b = np.intersect1d(one[:, 0], other[:, 0], assume_unique=True, return_indices=True)
    return sorted(zip(one[a, 1].tolist(), other[b, 1].tolist()))


def alike(one: np.ndarray, other: np.ndarray) -> int:
    """How many shared anchors stand equally far apart in both texts."""
    _, a, b = np.intersect1d(one[:, 0], other[:, 0], assume_unique=True, return_indices=True)
    shifts = other[b, 1].astype(np.int64) - one[a, 1]
    return int(np.unique(shifts, return_counts=True)[1].max(initial=0))


def edited(text: str, following: str) -> str:
    """The text with its second half replaced by as much of the following text's beginning."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def anchors(docs: DataFrame) -> DataFrame:
    """doc_id, position and anchor of every anchor of ``docs`` (doc_id, text), to join texts by."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                positions, hashes = syncmers(text or "")
                ids = pa.array([doc_id] * len(positions), pa.int64())
                yield pa.RecordBatch.from_arrays([ids, pa.array(positions, pa.int64()), pa.array(hashes.astype(np.int64))], ["doc_id", "position", "anchor"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, position long, anchor long")


def _count_up_to(bounds: list[int], value: Column) -> Column:
    """How many of the ascending bounds are no greater than the value, by binary search."""
    if not bounds:
        return F.lit(0)
    listed = F.lit(bounds)

    def step(low: Column, width: Column) -> Column:
        ahead = low + width
        return F.when((ahead <= len(bounds)) & (F.get(listed, ahead - 1) <= value), ahead).otherwise(low)

    widths = F.lit([1 << n for n in reversed(range(len(bounds).bit_length()))])
    return F.when(value.isNull(), 0).otherwise(F.aggregate(widths, F.lit(0), step))


def with_next(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text) in buckets of neighbouring ids, one to a partition, each in order.

    The last row of a partition (``_ahead``) is the first of the next bucket, so that every row has its
    successor beside it although texts are moved once.
    """
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"))
    total = ids.count()
    buckets = min(MAX_BUCKETS, math.ceil(total / ROWS_PER_BUCKET))
    bounds: list[int] = []
    if buckets > 1:
        shares = [n / buckets for n in range(1, buckets)]
        found = ids.agg(F.percentile_approx("doc_id", shares, 20 * buckets).alias("bounds")).first()["bounds"]
        bounds = sorted(set(found or []))
    bucket = _count_up_to(bounds, F.col("doc_id")).alias("_bucket")
    first = F.min(F.struct(F.col("doc_id").isNotNull().alias("some"), F.col("doc_id"))).alias("first")
    heads = ids.groupBy(bucket).agg(first).orderBy("_bucket").collect()  # one row a bucket
    before = [heads[n - 1]["_bucket"] for n in range(len(heads))]
    spark = docs.sparkSession
    ahead = spark.createDataFrame([(h["first"]["doc_id"], b) for h, b in zip(heads, before)], "head_id long, _before int")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("_bucket", bucket)
    marked = rows.join(F.broadcast(ahead), F.col("doc_id").eqNullSafe(F.col("head_id")), "left")
    places = F.array(F.col("_bucket"), F.when(F.col("_before").isNotNull(), F.col("_before")))
    dealt = marked.select("doc_id", "text", F.posexplode(places).alias("_ahead", "_at")).where("_at is not null")
    return dealt.repartitionById(max(1, len(bounds) + 1), F.col("_at")).sortWithinPartitions(
        "_ahead", "doc_id", F.xxhash64("text")
    )


def fingerprints(docs: DataFrame, density: int = DENSITY) -> DataFrame:
    """Fingerprints of each text and of its edited text, and how like and how alike in place the edited and the next text are."""
    kinds = pa.schema(
        [("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64()), ("alike_edited", pa.int64()), ("alike_next", pa.int64())]
    )

    def compared(doc_id: int | None, text: str, own: np.ndarray, following: str, its: np.ndarray) -> tuple:
        changed = edited(text, following)
        new = sketch(changed)
        digest = hashlib.sha256(changed.encode()).hexdigest()
        prints = (written_out(fingerprint(own, density)), written_out(fingerprint(new, density)))
        return doc_id, len(text), digest, *prints, likeness(own, new), likeness(own, its), alike(own, new), alike(own, its)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, last, waiting = [], None, 0
        for batch in batches:
            for doc_id, text, ahead in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "_ahead"))):
                text = text or ""
                own = sketch(text)
                if last is not None:
                    rows.append(compared(*last, text, own))
                    waiting += len(rows[-1][3]) + len(rows[-1][4])
                last = None if ahead else (doc_id, text, own)
                if len(rows) == 1000 or waiting > CHARS_WAITING:
                    waiting = 0
                    yield pa.RecordBatch.from_pylist([dict(zip(kinds.names, r)) for r in rows], kinds)
                    rows = []
        if rows:
            yield pa.RecordBatch.from_pylist([dict(zip(kinds.names, r)) for r in rows], kinds)

    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, alike_edited long, alike_next long"
    return with_next(docs).mapInArrow(run, schema)
