"""Retention: cutoffs, expired raw files, audit archive and the maintenance run."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from logloom.functions.normalize import is_audit_file
from logloom.functions.times import iso_minus, utc_now
from logloom.operators.filters import expired
from logloom.operators.index import LogIndex
from logloom.sources.byte_ranges import copy_file, delete_file
from logloom.sources.files import NDJSON_GLOB, list_files, path_prefix, root_path

DEFAULT_DAYS = 30
DEFAULT_AUDIT_DAYS = 365


def cutoffs(now: str, days: float = DEFAULT_DAYS, audit_days: float = DEFAULT_AUDIT_DAYS) -> tuple[str, str]:
    """Index cutoffs of the two classes. Zero days means everything before ``now``."""
    return iso_minus(now, days=days), iso_minus(now, days=audit_days)


def kept_entries(entries: DataFrame, normal_cutoff: str, audit_cutoff: str) -> DataFrame:
    return entries.where(~expired(normal_cutoff, audit_cutoff))


def prune_report(entries: DataFrame, normal_cutoff: str, audit_cutoff: str) -> DataFrame:
    """What a prune with these cutoffs deletes, by class."""
    return (
        entries.where(expired(normal_cutoff, audit_cutoff))
        .agg(
            F.count_if(~F.col("is_audit")).alias("normal_entries_deleted"),
            F.count_if("is_audit").alias("audit_entries_deleted"),
            F.count("*").alias("entries_deleted"),
            F.coalesce(F.sum(F.size("fields")), F.lit(0)).alias("fields_deleted"),
        )
    )


def expired_files(
    listing: DataFrame, now: str, days: float = DEFAULT_DAYS, audit_days: float = DEFAULT_AUDIT_DAYS
) -> DataFrame:
    """Files older than the retention of their class; zero or fewer days switch a class off."""

    def old(keep_days: float) -> Column:
        if keep_days <= 0:
            return F.lit(False)
        return F.unix_millis("modified_at") < F.unix_millis(F.lit(iso_minus(now, days=keep_days)).cast("timestamp"))

    audit = is_audit_file(F.col("path"))
    return listing.withColumn("is_audit_file", audit).where(F.when(audit, old(audit_days)).otherwise(old(days)))


def _copier(source_prefix: str, target_prefix: str, target_root: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = []
            for row in batch.to_pylist():
                target = f"{target_root}/{row['source_file']}"
                ok.append(copy_file(source_prefix, row["path"], target_prefix, target) == row["length"])
            yield batch.append_column("ok", pa.array(ok, pa.bool_()))

    return run


def archive_files(files: DataFrame, root: str, backup: str) -> DataFrame:
    """Copy files byte for byte below ``backup``, keeping relative paths; adds ``ok``."""
    spark = files.sparkSession
    run = _copier(path_prefix(spark, root), path_prefix(spark, backup), root_path(spark, backup))
    plan = files.select("path", "source_file", "length", "is_audit_file")
    tasks = 4 * spark.sparkContext.defaultParallelism
    return plan.repartition(tasks, "source_file").mapInArrow(
        run, "path string, source_file string, length bigint, is_audit_file boolean, ok boolean"
    )


def _deleter(prefix: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            gone = [delete_file(prefix, row["path"]) for row in batch.to_pylist()]
            yield batch.append_column("deleted", pa.array(gone, pa.bool_()))

    return run


def delete_files(files: DataFrame, root: str) -> DataFrame:
    """Delete the files on the executors; adds ``deleted``. Deleting twice does no harm."""
    spark = files.sparkSession
    plan = files.select("path", "source_file", "is_audit_file")
    tasks = 4 * spark.sparkContext.defaultParallelism
    return plan.repartition(tasks, "source_file").mapInArrow(
        _deleter(path_prefix(spark, root)), "path string, source_file string, is_audit_file boolean, deleted boolean"
    )


def clean_up_files(
    spark: SparkSession,
    root: str,
    now: str,
    work_dir: str,
    days: float = DEFAULT_DAYS,
    audit_days: float = DEFAULT_AUDIT_DAYS,
    backup: str | None = None,
    glob: str = NDJSON_GLOB,
) -> dict[str, int]:
    """Archive expiring audit files if ``backup`` is given, then delete what has expired.

    The plan is written down first: the listing changes while files go, and a file is
    deleted only if the plan says so and its copy is complete.
    """
    plan_path = f"{work_dir}/expired"
    listing = list_files(spark, root, glob)
    expired_files(listing, now, days, audit_days).write.mode("overwrite").parquet(plan_path)
    plan = spark.read.parquet(plan_path)
    if backup:
        copies_path = f"{work_dir}/copies"
        archive_files(plan.where("is_audit_file"), root, backup).write.mode("overwrite").parquet(copies_path)
        copied = spark.read.parquet(copies_path).where("ok").select("path")
        safe = plan.where("is_audit_file").join(copied, "path", "left_semi")
        plan = plan.where("NOT is_audit_file").unionByName(safe)
    done_path = f"{work_dir}/deleted"
    delete_files(plan, root).write.mode("overwrite").parquet(done_path)
    row = (
        spark.read.parquet(done_path)
        .agg(
            F.count_if(F.col("deleted") & ~F.col("is_audit_file")).alias("normal_files_deleted"),
            F.count_if(F.col("deleted") & F.col("is_audit_file")).alias("audit_files_deleted"),
        )
        .head()
    )
    return row.asDict()


def run_maintenance(
    index: LogIndex,
    root: str,
    work_dir: str,
    now: str | None = None,
    index_days: float = DEFAULT_DAYS,
    index_audit_days: float = DEFAULT_AUDIT_DAYS,
    file_days: float = DEFAULT_DAYS,
    file_audit_days: float = DEFAULT_AUDIT_DAYS,
    backup: str | None = None,
    glob: str = NDJSON_GLOB,
) -> dict:
    """One maintenance pass: raw files, index rows, and compaction if anything was deleted."""
    now = now or utc_now()
    report = clean_up_files(index.spark, root, now, work_dir, file_days, file_audit_days, backup, glob)
    report["files_deleted"] = report["normal_files_deleted"] + report["audit_files_deleted"]
    report.update(index.prune(*cutoffs(now, index_days, index_audit_days)))
    compacted = report["entries_deleted"] > 0 or report["files_deleted"] > 0
    if compacted:
        index.compact()
        index.vacuum()
    report["vacuum_runs"] = int(compacted)
    index.log_report("maintenance", "retention", now, report)
    return report
