"""What is known of each data file without opening it, and which files a query can match.

A file's row holds its counts, the range of its timestamps and ids, and a Bloom filter of the fields
its entries have: every (name, value) pair, and level, event and source file under names of their own. A query
reads a file only if the range and the filter leave a chance that it matches.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from logloom.functions.normalize import INGESTED
from logloom.operators.filters import Cursor, LogQuery
from logloom.schema import ENTRY_SCHEMA

FILE_SCHEMA = T.StructType(
    [
        T.StructField("path", T.StringType()),  # below the index
        T.StructField("line_kind", T.StringType()),
        T.StructField("is_audit", T.BooleanType()),
        T.StructField("event_date", T.DateType()),
        T.StructField("bytes", T.LongType()),
        T.StructField("rows", T.LongType()),
        T.StructField("fields", T.LongType()),
        T.StructField("min_time", T.StringType()),
        T.StructField("max_time", T.StringType()),
        T.StructField("min_id", T.LongType()),
        T.StructField("max_id", T.LongType()),
        T.StructField("bits", T.LongType()),
        T.StructField("bloom", T.BinaryType()),
    ]
)
FILE_COLUMNS = [f.name for f in FILE_SCHEMA.fields]
LEVEL, EVENT, SOURCE = "\0level", "\0event", "\0source"  # no field of a JSON object is likely to be named so
BITS_PER_PAIR, PROBES = 8, 5
MAX_NAMED = 256  # pairs that one condition asks for at most; more are not worth it

_SUMMARY = (
    "path string, line_kind string, is_audit boolean, event_date date, bytes bigint, rows bigint, fields bigint, min_time string, "
    "max_time string, min_id bigint, max_id bigint, pairs binary"
)
_SUMMARY_KINDS = pa.schema(
    [
        ("path", pa.string()),
        ("line_kind", pa.string()),
        ("is_audit", pa.bool_()),
        ("event_date", pa.date32()),
        ("bytes", pa.int64()),
        ("rows", pa.int64()),
        ("fields", pa.int64()),
        ("min_time", pa.string()),
        ("max_time", pa.string()),
        ("min_id", pa.int64()),
        ("max_id", pa.int64()),
        ("pairs", pa.binary()),
    ]
)
_FILE_KINDS = pa.schema([*list(_SUMMARY_KINDS)[:-1], ("bits", pa.int64()), ("bloom", pa.binary())])


def pair_hash(name: Column, value: Column) -> Column:
    return F.xxhash64(name, value)


def _least(a, b):
    return b if a is None else a if b is None else min(a, b)


def _most(a, b):
    return b if a is None else a if b is None else max(a, b)


class _Summary:
    """Facts of one file, as far as a task has seen it."""

    def __init__(self, head: dict):
        self.facts = head | {"rows": 0, "fields": 0, "min_time": None, "max_time": None, "min_id": None, "max_id": None}
        self.pairs: list[np.ndarray] = []

    def add(self, rows: int, fields: int, times: tuple, ids: tuple, pairs: np.ndarray) -> None:
        f = self.facts
        f["rows"] += rows
        f["fields"] += fields
        f["min_time"], f["max_time"] = _least(f["min_time"], times[0]), _most(f["max_time"], times[1])
        f["min_id"], f["max_id"] = _least(f["min_id"], ids[0]), _most(f["max_id"], ids[1])
        self.pairs.append(np.unique(pairs))

    def distinct(self) -> np.ndarray:
        return np.unique(np.concatenate(self.pairs)) if self.pairs else np.zeros(0, np.int64)


def _summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each file that a task reads a part of."""
    held: dict[str, _Summary] = {}
    for batch in batches:
        paths = batch.column("path").dictionary_encode()
        codes = paths.indices.to_numpy()
        for code, path in enumerate(paths.dictionary.to_pylist()):
            part = batch.filter(pa.array(codes == code)) if len(paths.dictionary) > 1 else batch
            first = part.slice(0, 1).to_pylist()[0]
            if path not in held:
                held[path] = _Summary({name: first[name] for name in ("path", "line_kind", "is_audit", "event_date", "bytes")})
            ids = part.column("id").to_numpy()
            times = pc.min_max(part.column("timestamp")).as_py()
            held[path].add(
                len(part),
                int(part.column("field_count").fill_null(0).to_numpy().sum()),
                (times["min"], times["max"]),
                (int(ids.min()), int(ids.max())),
                part.column("pairs").flatten().to_numpy(),
            )
    rows = [s.facts | {"pairs": s.distinct().tobytes()} for s in held.values()]
    if rows:
        yield pa.RecordBatch.from_pylist(rows, _SUMMARY_KINDS)


def bloom_filter(pairs: np.ndarray) -> tuple[int, bytes]:
    """Size in bits (a power of two) and bits of the Bloom filter of 64-bit hashes."""
    bits = 64
    while bits < BITS_PER_PAIR * len(pairs):
        bits *= 2
    hashes = pairs.astype(np.int64).view(np.uint64)
    low, high = hashes & np.uint64(0xFFFFFFFF), (hashes >> np.uint64(32)) | np.uint64(1)
    set_ = np.zeros(bits, bool)
    for n in range(PROBES):
        set_[((low + np.uint64(n) * high) % np.uint64(bits)).astype(np.int64)] = True
    return bits, np.packbits(set_, bitorder="little").tobytes()


def _merged(table: pa.Table) -> pa.Table:
    """The summaries of one file as its row."""
    rows = table.to_pylist()
    whole = _Summary({name: rows[0][name] for name in ("path", "line_kind", "is_audit", "event_date", "bytes")})
    for r in rows:
        whole.add(r["rows"], r["fields"], (r["min_time"], r["max_time"]), (r["min_id"], r["max_id"]), np.frombuffer(r["pairs"], np.int64))
    bits, bloom = bloom_filter(whole.distinct())
    return pa.Table.from_pylist([whole.facts | {"bits": bits, "bloom": bloom}], _FILE_KINDS)


def described(spark: SparkSession, root: str, folder: str) -> DataFrame:
    """A manifest row for each data file below ``root``/``folder``; a large file is read by several tasks."""
    rows = spark.read.schema(ENTRY_SCHEMA).option("recursiveFileLookup", "true").parquet(f"{root}/{folder}")
    path = F.concat(F.lit(f"{folder}/"), F.substring_index(F.col("_metadata.file_path"), f"/{folder}/", -1))
    kind = F.regexp_extract(F.col("_metadata.file_path"), "/line_kind=([a-z_]+)/", 1)
    own = {LEVEL: "level", EVENT: "event", SOURCE: "source_file"}
    pairs = F.concat(
        F.coalesce(F.transform(F.map_entries("fields"), lambda e: pair_hash(e["key"], e["value"])), F.array().cast("array<bigint>")),
        F.array(*(pair_hash(F.lit(name), F.col(column)) for name, column in own.items())),
    )
    facts = rows.select(
        path.alias("path"),
        kind.alias("line_kind"),
        "is_audit",
        "event_date",
        F.col("_metadata.file_size").alias("bytes"),
        "timestamp",
        "id",
        "field_count",
        pairs.alias("pairs"),
    )
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in FILE_SCHEMA.fields)
    return facts.mapInArrow(_summaries, _SUMMARY).groupBy("path").applyInArrow(_merged, schema)


def may_hold(pairs: list[tuple[str, str]]) -> Column:
    """Whether a file may have an entry with one of the (name, value) pairs."""

    def is_set(hashed: Column, probe: Column) -> Column:
        low, high = hashed.bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned(hashed, 32).bitwiseOR(F.lit(1).cast("bigint"))
        place = (low + probe * high) % F.col("bits")
        byte = F.conv(F.hex(F.substring(F.col("bloom"), (F.floor(place / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
        return F.call_function("shiftright", byte, (place % 8).cast("int")).bitwiseAND(F.lit(1)) == 1

    hashes = F.array(*(pair_hash(F.lit(name), F.lit(value)) for name, value in pairs))
    probes = F.array(*(F.lit(n).cast("bigint") for n in range(PROBES)))
    return F.exists(hashes, lambda h: F.forall(probes, lambda n: is_set(h, n)))


def reachable(query: LogQuery) -> list[Column]:
    """Conditions on manifest rows that every file with a match meets."""
    found = [F.col("line_kind") == INGESTED]
    if query.audit is not None:
        found.append(F.col("is_audit") == F.lit(query.audit))
    if query.from_:
        found.append(F.col("max_time") >= query.from_)
    if query.to:
        found.append(F.col("min_time") <= query.to)
    if cursor := Cursor.decode(query.cursor):
        found.append(F.col("min_time") <= cursor.timestamp)
    if query.filters_on_field:
        found.append(may_hold([(query.field, query.value)]))
    if query.level:
        found.append(may_hold([(LEVEL, query.level.upper())]))
    return found
