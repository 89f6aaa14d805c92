"""Lines appended to files since the recorded offsets, read by byte range on the executors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from logloom.sources.byte_ranges import (
    RANGE_BYTES,
    last_line_end,
    line_batches,
    line_count,
    open_file,
    range_blocks,
)
from logloom.sources.files import path_prefix
from logloom.sources.numbering import running_base

_FIXED = (("source_file", pa.string()), ("path", pa.string()), ("generation", pa.int32()))
MAX_TASKS = 100_000
_RANGE_COLUMNS = ["source_file", "path", "generation", "lines_before", "first", "limit", "start", "end"]


def _limits(prefix: str, include_unterminated: bool):
    """Replace each file's end by the end of its last complete line."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            limits = []
            for row in batch.to_pylist():
                if row["first"] >= row["length"]:
                    limits.append(row["length"])
                    continue
                with open_file(prefix, row["path"]) as source:
                    # What was the end of a file when it was listed is the middle of a line once it has grown.
                    whole = include_unterminated and source.size() <= row["length"]
                    limits.append(row["length"] if whole else last_line_end(source, row["first"], row["length"]))
            yield batch.append_column("limit", pa.array(limits, pa.int64()))

    return run


def _read_range(prefix: str, row: dict) -> Iterator[bytes]:
    with open_file(prefix, row["path"]) as source:
        yield from range_blocks(source, row["start"], row["end"], row["first"], row["limit"])


def _counts(prefix: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = [sum(map(line_count, _read_range(prefix, row))) for row in batch.to_pylist()]
            yield batch.append_column("range_lines", pa.array(counts, pa.int64()))

    return run


def _lines(prefix: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                before = row["seq_base"]
                for text in (lines for block in _read_range(prefix, row) for _, lines in line_batches(block)):
                    seq = np.arange(before + 1, before + len(text) + 1)
                    before += len(text)
                    fixed = [pa.repeat(pa.scalar(row[name], kind), len(text)) for name, kind in _FIXED]
                    number = seq + (row["lines_before"] - row["file_base"])
                    yield pa.RecordBatch.from_arrays([*fixed, pa.array(number), pa.array(seq), text], [*(n for n, _ in _FIXED), "line_number", "line_seq", "line"])

    return run


def _tasks(spark: SparkSession, pieces: int, size: int, piece_bytes: int) -> int:
    """A task for each piece's worth of bytes; many small pieces share as many tasks as run at once."""
    return max(1, min(pieces, max(size // piece_bytes + 1, spark.sparkContext.defaultParallelism), MAX_TASKS))


def read_appended(
    changes: DataFrame,
    n_files: int,
    root: str,
    work_dir: str,
    include_unterminated: bool = False,
    piece_bytes: int = RANGE_BYTES,
) -> tuple[DataFrame, DataFrame]:
    """Unread lines of ``changes`` and the new state of each of its files.

    ``changes`` has ``n_files`` rows of source_file, path, length, first (bytes already read), lines_before and
    generation. Big files are cut into ranges, so one growing file is read by many tasks.
    A pass over the ranges counts lines; a second one numbers and returns them.
    """
    spark = changes.sparkSession
    prefix = path_prefix(spark, root)
    files_path, ranges_path = f"{work_dir}/files", f"{work_dir}/ranges"

    plan = changes.select("source_file", "path", "generation", "lines_before", "first", "length")
    (
        plan.repartition(_tasks(spark, n_files, 0, piece_bytes), "source_file")
        .mapInArrow(
            _limits(prefix, include_unterminated),
            "source_file string, path string, generation int, lines_before bigint, first bigint, length bigint, "
            "limit bigint",
        )
        .write.mode("overwrite")
        .parquet(files_path)
    )
    files = spark.read.parquet(files_path)
    pieces = files.where(F.col("limit") > F.col("first")).withColumn(
        "start", F.explode(F.sequence(F.col("first"), F.col("limit") - 1, F.lit(piece_bytes).cast("bigint")))
    )
    pieces = pieces.withColumn("end", F.least(F.col("start") + piece_bytes, F.col("limit"))).select(*_RANGE_COLUMNS)
    unread = F.col("limit") - F.col("first")
    n_ranges, size = files.agg(F.sum(F.ceil(unread / piece_bytes)), F.sum(unread)).head()
    tasks = _tasks(spark, int(n_ranges or 0), int(size or 0), piece_bytes)
    columns = (
        "source_file string, path string, generation int, lines_before bigint, first bigint, limit bigint, "
        "start bigint, end bigint"
    )
    counted = pieces.repartition(tasks, "source_file", "start").mapInArrow(
        _counts(prefix), f"{columns}, range_lines bigint"
    )
    numbered = running_base(counted, ["source_file", "start"], "range_lines", "seq_base", ranges_path)
    per_file = spark.read.parquet(ranges_path).groupBy("source_file").agg(F.sum("range_lines").alias("new_lines"))
    file_bases = numbered.groupBy("source_file").agg(F.min("seq_base").alias("file_base"))
    lines = (
        numbered.join(file_bases, "source_file")
        .repartition(tasks, "source_file", "start")
        .mapInArrow(
            _lines(prefix),
            "source_file string, path string, generation int, line_number bigint, line_seq bigint, line string",
        )
    )
    state = files.join(per_file, "source_file", "left").select(
        "source_file",
        F.col("limit").alias("byte_offset"),
        (F.col("lines_before") + F.coalesce("new_lines", F.lit(0))).alias("lines"),
        F.coalesce("new_lines", F.lit(0)).alias("new_lines"),
    )
    return lines, state
