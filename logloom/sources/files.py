"""File discovery and change classification."""

from __future__ import annotations

import fnmatch
import re
from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from logloom.session import scratch_path
from logloom.sources.byte_ranges import delete_file, list_folder

NDJSON_GLOB = "*.[nN][dD][jJ][sS][oO][nN]"
# Spark's text sink always writes .txt files.
SINK_GLOB = "*.{txt,[nN][dD][jJ][sS][oO][nN]}"

MAX_TASKS = 10_000
NEW, APPENDED, UNCHANGED, REWRITTEN, VANISHED = "new", "appended", "unchanged", "rewritten", "vanished"

_LISTING = "path string, source_file string, length bigint, modified_at timestamp"
_FOUND = "is_folder boolean, path string, length bigint, modified_ms bigint"
_FOUND_KINDS = pa.schema([("is_folder", pa.bool_()), ("path", pa.string()), ("length", pa.int64()), ("modified_ms", pa.int64())])
BEING_WRITTEN = "_temporary"  # where Spark's writers keep files that are not finished
NAMES_AT_ONCE = 20_000  # names that a task lists before it leaves the folders that remain to others


def file_system(spark: SparkSession, location: str):
    """Hadoop path and file system of a location."""
    path = spark._jvm.org.apache.hadoop.fs.Path(location)
    return path, path.getFileSystem(spark._jsc.hadoopConfiguration())


def path_exists(spark: SparkSession, location: str) -> bool:
    path, fs = file_system(spark, location)
    return fs.exists(path)


def delete_path(spark: SparkSession, location: str) -> bool:
    path, fs = file_system(spark, location)
    return fs.delete(path, True)


def rename_path(spark: SparkSession, source: str, target: str) -> bool:
    path, fs = file_system(spark, source)
    return fs.rename(path, spark._jvm.org.apache.hadoop.fs.Path(target))


def root_path(spark: SparkSession, root: str) -> str:
    """Absolute path of ``root`` without scheme and authority."""
    path, fs = file_system(spark, root)
    return fs.makeQualified(path).toUri().getPath().rstrip("/")


def path_prefix(spark: SparkSession, root: str) -> str:
    """``scheme://authority`` of a folder, empty for the local file system."""
    path, fs = file_system(spark, root)
    uri = fs.makeQualified(path).toUri()
    scheme, authority = uri.getScheme() or "", uri.getAuthority() or ""
    return "" if scheme in ("", "file") else f"{scheme}://{authority}"


def relative_to(path: Column, root: str) -> Column:
    return F.substr(path, F.lit(len(root) + 2))


def name_pattern(glob: str) -> str:
    """A regular expression for the names that a glob with ``*``, ``?``, ``[..]`` and ``{a,b}`` matches."""
    group = re.search(r"\{([^{}]*)\}", glob)
    if not group:
        return fnmatch.translate(glob)
    return "|".join(name_pattern(glob[: group.start()] + part + glob[group.end() :]) for part in group.group(1).split(","))


def _walk(prefix: str, pattern: str, most: int):
    """List folders and what is below them; folders beyond ``most`` names of a task are returned unlisted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matches = re.compile(pattern).match
        open_: deque[str] = deque()
        listed = 0
        for batch in batches:
            open_.extend(batch.column("path").to_pylist())
            while open_ and listed < most:
                folder = open_.popleft()
                rows = []
                for info in list_folder(prefix, folder):
                    listed += 1
                    path = f"{folder}/{info.base_name}"
                    if info.type == pafs.FileType.Directory:
                        if info.base_name != BEING_WRITTEN:
                            open_.append(path)
                    elif info.type == pafs.FileType.File and matches(info.base_name):
                        rows.append((False, path, info.size, info.mtime_ns // 1_000_000))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _FOUND_KINDS)], schema=_FOUND_KINDS)
            if open_:
                yield pa.RecordBatch.from_pylist([{"is_folder": True, "path": f} for f in open_], _FOUND_KINDS)
                open_.clear()

    return run


def list_files(
    spark: SparkSession, root: str, glob: str = NDJSON_GLOB, folders: DataFrame | None = None, at_once: int = NAMES_AT_ONCE
) -> DataFrame:
    """One row per matching file below ``root``: path, source_file, length, modified_at.

    All names count, empty files and those that begin with ``_`` or ``.`` too; only folders in which
    Spark is writing are left out. Folders are listed by tasks, level by level where there are many, and
    the listing is written down, so that it says the same however often it is read. ``folders`` (column
    ``path``) limits the search to folders below ``root``. A missing root gives an empty result.
    """
    base = root_path(spark, root)
    frontier = spark.createDataFrame([(base,)], "path string") if folders is None else folders.select("path")
    walk = _walk(path_prefix(spark, root), name_pattern(glob), at_once)
    found: list[str] = []
    while True:
        found.append(scratch_path(spark, "listing"))
        frontier.mapInArrow(walk, _FOUND).write.parquet(found[-1])
        left = spark.read.schema(_FOUND).parquet(found[-1]).where("is_folder").select("path")
        folders_left = left.count()
        if not folders_left:
            break
        frontier = left.repartition(min(folders_left, MAX_TASKS))
    return spark.read.schema(_FOUND).parquet(*found).where("NOT is_folder").select(
        "path", relative_to(F.col("path"), base).alias("source_file"), "length", F.timestamp_millis("modified_ms").alias("modified_at")
    )


def delete_listed(files: DataFrame, root: str) -> int:
    """Delete files (column ``path``) below ``root`` in tasks; returns how many are gone."""
    prefix = path_prefix(files.sparkSession, root)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"gone": [delete_file(prefix, path) for path in batch.column("path").to_pylist()]})

    return files.select("path").mapInArrow(run, "gone boolean").where("gone").count()


def classify_changes(listing: DataFrame, ledger: DataFrame) -> DataFrame:
    """Compare a listing with the recorded state of each file.

    A file is rewritten when it is shorter than the bytes already read, or exactly as long
    with a new modification time.
    """
    state = ledger.select(
        "source_file",
        F.col("byte_offset").alias("old_offset"),
        F.col("modified_at").alias("old_modified_at"),
        F.col("lines").alias("old_lines"),
        F.col("generation").alias("old_generation"),
    )
    length, offset = F.col("length"), F.col("old_offset")
    touched = F.col("modified_at") != F.col("old_modified_at")
    status = (
        F.when(length.isNull(), F.lit(VANISHED))
        .when(offset.isNull(), F.lit(NEW))
        .when((length < offset) | ((length == offset) & touched), F.lit(REWRITTEN))
        .when(length > offset, F.lit(APPENDED))
        .otherwise(F.lit(UNCHANGED))
    )
    return listing.join(state, "source_file", "full_outer").withColumn("status", status)
