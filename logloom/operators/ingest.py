"""Producer-stamped ingest of payload requests into NDJSON files."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from logloom.functions.times import iso_millis, utc_ntz
from logloom.session import scratch_path
from logloom.sources.byte_ranges import delete_file, list_folder, locate
from logloom.sources.files import BEING_WRITTEN, MAX_TASKS, delete_path, path_prefix, root_path
from logloom.sources.payloads import (
    DEFAULT_MAX_BODY_BYTES,
    assign_producers,
    explode_records,
    parse_requests,
)

# Fixed value: what a producer id may look like.
PRODUCER_ID_PATTERN = r"^[A-Za-z0-9][A-Za-z0-9._-]{0,127}$"
INGEST_FOLDER = "ingest"
FOLDERS_AT_ONCE = 1000  # folders that a task fills
# As Spark names the folders of partitions.
_ESCAPED = re.compile("[\x01-\x1f\"#%'*/:=?\\\\\x7f{\\[\\]^]")
_NO_VALUE = "__HIVE_DEFAULT_PARTITION__"


def stamp_records(records: DataFrame) -> DataFrame:
    """Add ``line``: the record as JSON with producerId and ingestedAt set by the server.

    Values the sender put there are overwritten. ``line`` is NULL for records that are not
    objects; those are rejected.
    """
    members = F.try_variant_get("record", "$", "map<string,variant>")
    own = F.map_filter(members, lambda key, _: ~key.isin("producerId", "ingestedAt"))
    stamp = F.create_map(
        F.lit("producerId"),
        F.col("producer_id").cast("variant"),
        F.lit("ingestedAt"),
        iso_millis(utc_ntz(F.col("received_at"))).cast("variant"),
    )
    return records.withColumn("line", F.to_json(F.map_concat(own, stamp))).drop("record")


def accept_records(
    requests: DataFrame, producers: DataFrame, max_bytes: int = DEFAULT_MAX_BODY_BYTES
) -> tuple[DataFrame, DataFrame]:
    """Requests with their status, and the stamped records of the accepted ones."""
    parsed = parse_requests(assign_producers(requests, producers), max_bytes)
    return parsed, stamp_records(explode_records(parsed))


def request_report(parsed: DataFrame) -> DataFrame:
    """One row per request: request_id, producer_id, status, accepted, rejected.

    Counted inside each request's own array, without exploding or shuffling records.
    """
    is_object = F.transform("records", lambda r: F.schema_of_variant(r).startswith("OBJECT"))
    accepted = F.size(F.filter(is_object, lambda flag: flag))
    total = F.size("records")

    def counted(value: Column) -> Column:
        return F.when(F.col("records").isNull(), F.lit(0)).otherwise(value).cast("bigint")

    return parsed.select(
        "request_id",
        "producer_id",
        "status",
        counted(accepted).alias("accepted"),
        counted(total - accepted).alias("rejected"),
    )


def _folder(values: dict[str, str | None]) -> str:
    return "/".join(f"{name}={_ESCAPED.sub(lambda c: f'%{ord(c[0]):02X}', value or '') or _NO_VALUE}" for name, value in values.items())


def _runs(column: pa.Array) -> Iterator[tuple[int, int]]:
    """Start and end of each run of equal values."""
    codes = column.dictionary_encode(null_encoding="encode").indices.to_numpy()
    edges = [0, *(np.flatnonzero(np.diff(codes)) + 1).tolist(), len(codes)]
    return zip(edges, edges[1:])


def _write_lines(prefix: str, staging: str, day: str, batch: str):
    """Write each producer's rows to one file; returns the files (``name``) and where they belong (``folder``)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filesystem, top = locate(prefix, staging)
        own = f"{top}/{uuid.uuid4().hex}"  # a task that is run again writes files of its own
        filesystem.create_dir(own, recursive=True)
        written: list[str | None] = []
        file = None
        try:
            for rows in batches:
                for start, end in _runs(rows.column("producer")) if rows.num_rows else ():
                    producer = rows.column("producer")[start].as_py()
                    if file is None or producer != written[-1]:
                        if file is not None:
                            file.close()
                        file = filesystem.open_output_stream(f"{own}/{len(written)}")
                        written.append(producer)
                    lines = pc.fill_null(rows.column("line").slice(start, end - start), "")
                    file.write("".join(f"{text}\n" for text in lines.to_pylist()).encode())
        finally:
            if file is not None:
                file.close()
        folders = [_folder({"producer": producer, "day": day, "batch": batch}) for producer in written]
        names = [f"{own.rpartition('/')[2]}/{n}" for n in range(len(written))]
        yield pa.RecordBatch.from_pydict({"folder": pa.array(folders, pa.string()), "name": pa.array(names, pa.string())})

    return run


def _publish(prefix: str, staging: str, target: str):
    """Put the files of each folder in the place of those it holds; what is there already stays when a task is run again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filesystem, top = locate(prefix, target)
        _, source = locate(prefix, staging)
        for batch in batches:
            for row in batch.to_pylist():
                new = {f"part-{name.replace('/', '-')}.txt": name for name in row["names"]}
                folder = f"{top}/{row['folder']}"
                filesystem.create_dir(folder, recursive=True)
                there = {info.base_name for info in list_folder(prefix, f"{target}/{row['folder']}")}
                for name, staged in new.items():
                    if name not in there:
                        filesystem.move(f"{source}/{staged}", f"{folder}/{name}")
                for name in there.difference(new):
                    delete_file(prefix, f"{target}/{row['folder']}/{name}")
            yield pa.RecordBatch.from_pydict({"files": pa.array([len(names) for names in batch.column("names").to_pylist()], pa.int64())})

    return run


def write_producer_files(stamped: DataFrame, root: str, batch: str, flushed_at: str) -> None:
    """Write accepted records below ``root``/ingest by producer and UTC day of the flush.

    Files carry the name of the batch: writing the same batch again replaces its files, so a
    repeated batch adds nothing. Busy producers are split over several files. There may be very many
    producers, so tasks write the files aside and then put them in their places; the driver touches none.
    """
    spark = stamped.sparkSession
    target = f"{root.rstrip('/')}/{INGEST_FOLDER}"
    staging = f"{target}/{BEING_WRITTEN}/{uuid.uuid4().hex}"
    place = path_prefix(spark, root), root_path(spark, staging)
    rows = stamped.where(F.col("line").isNotNull()).select(
        "line", "received_at", "request_id", "position", F.col("producer_id").alias("producer")
    )
    listed = scratch_path(spark, "producer-files")
    (
        rows.hint("rebalance", "producer")
        .sortWithinPartitions("producer", "received_at", "request_id", "position")
        .select("line", "producer")
        .mapInArrow(_write_lines(*place, flushed_at[:10], batch), "folder string, name string")
        .write.parquet(listed)
    )
    written = spark.read.schema("folder string, name string").parquet(listed)
    tasks = min(MAX_TASKS, max(spark.sparkContext.defaultParallelism, written.count() // FOLDERS_AT_ONCE + 1))
    (
        written.repartition(tasks, "folder")
        .groupBy("folder")
        .agg(F.collect_list("name").alias("names"))
        .mapInArrow(_publish(*place, root_path(spark, target)), "files bigint")
        .agg(F.sum("files"))
        .collect()
    )
    delete_path(spark, staging)


def parse_producer_mappings(mappings: DataFrame) -> DataFrame:
    """Validate ``token=producer`` lists (column ``mapping``), one row per entry.

    Adds entry, token, producer_id and ``problem``: NULL, ``syntax``, ``empty``,
    ``producer_id`` or ``duplicate``. A token repeated within one list (``config_id``) is a
    duplicate from its second use on.
    """
    items = mappings.select("config_id", F.posexplode(F.split("mapping", ",")).alias("position", "_raw"))
    items = items.withColumn("entry", F.trim("_raw")).where(F.col("entry") != "").drop("_raw")
    cut = F.instr("entry", F.lit("="))
    shaped = items.withColumns(
        {
            "token": F.when(cut > 1, F.trim(F.expr("substring(entry, 1, instr(entry, '=') - 1)"))),
            "producer_id": F.when(cut > 1, F.trim(F.expr("substring(entry, instr(entry, '=') + 1)"))),
            "_syntax": (cut <= 1) | (cut == F.length("entry")),
        }
    )
    firsts = (
        shaped.where(~F.col("_syntax"))
        .groupBy("config_id", "token")
        .agg(F.min("position").alias("_first"))
    )
    problem = (
        F.when(F.col("_syntax"), F.lit("syntax"))
        .when((F.col("token") == "") | (F.col("producer_id") == ""), F.lit("empty"))
        .when(~F.col("producer_id").rlike(PRODUCER_ID_PATTERN), F.lit("producer_id"))
        .when(F.col("position") > F.col("_first"), F.lit("duplicate"))
    )
    return shaped.join(firsts, ["config_id", "token"], "left").select(
        "config_id", "position", "entry", "token", "producer_id", problem.alias("problem")
    )


def producer_table(checked: DataFrame) -> DataFrame:
    """token → producer of the lists in which every entry is valid; one bad entry voids a list."""
    bad = checked.where(F.col("problem").isNotNull()).select("config_id").distinct()
    return checked.join(bad, "config_id", "left_anti").select("config_id", "token", "producer_id")
