"""Streaming ingest: following files, and queued payload requests.

``trigger`` takes the keyword arguments of ``DataStreamWriter.trigger``, for example
``{"processingTime": "2 seconds"}`` or ``{"availableNow": True}``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from logloom.functions.times import utc_now
from logloom.operators.index import LogIndex
from logloom.operators.ingest import INGEST_FOLDER, accept_records, request_report, write_producer_files
from logloom.sources.files import NDJSON_GLOB, SINK_GLOB, delete_path, root_path
from logloom.sources.payloads import DEFAULT_MAX_BODY_BYTES

DEFAULT_INGEST_TRIGGER = {"processingTime": "2 seconds"}
DEFAULT_FLUSH_TRIGGER = {"processingTime": "25 milliseconds"}


def follow_files(
    index: LogIndex,
    root: str,
    checkpoint: str,
    glob: str = NDJSON_GLOB,
    trigger: dict | None = None,
    now: Callable[[], str] = utc_now,
) -> StreamingQuery:
    """Index what is appended to files below ``root``, from where the index has read them to.

    The stream carries ticks and nothing else. What has been read of each file is the index's ledger, which a
    commit publishes together with the entries, so a batch that is repeated, a new checkpoint or a bulk run in
    between all go on where the last commit ends. Folders are listed and files probed by tasks, for any
    number of files.
    """
    ticks = index.spark.readStream.format("rate-micro-batch").option("rowsPerBatch", 1).load()

    def add(_: DataFrame, __: int) -> None:
        index.index_incremental(root, now(), glob, quiet=True)

    writer = ticks.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or DEFAULT_INGEST_TRIGGER)).start()


def ingest_requests(
    requests: DataFrame,
    producers: DataFrame,
    root: str,
    index: LogIndex,
    stream_id: str,
    checkpoint: str,
    max_bytes: int = DEFAULT_MAX_BODY_BYTES,
    trigger: dict | None = None,
    now: Callable[[], str] = utc_now,
) -> StreamingQuery:
    """Write accepted records of a request stream as producer files, index them, and report.

    The name of a batch is ``stream_id`` and its number; a stream restarted with a new
    checkpoint needs a new ``stream_id``. A failed batch is repeated as a whole, and repeating
    replaces its files and reports. The batch's own copy of the requests goes when all else is done.
    """
    base = root_path(index.spark, root)

    def flush(batch: DataFrame, batch_id: int) -> None:
        name = f"{stream_id}-{batch_id:012d}"
        work = f"{root.rstrip('/')}/_requests/{name}"
        batch.write.mode("overwrite").parquet(work)
        flushed_at = now()
        parsed, stamped = accept_records(index.spark.read.parquet(work), producers, max_bytes)
        write_producer_files(stamped, root, name, flushed_at)
        request_report(parsed).write.mode("overwrite").parquet(f"{root.rstrip('/')}/_reports/batch={name}")
        written = index.spark.createDataFrame([(f"{base}/{INGEST_FOLDER}",)], "path string")
        index.index_incremental(root, flushed_at, SINK_GLOB, folders=written)
        delete_path(index.spark, work)

    writer = requests.writeStream.foreachBatch(flush).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or DEFAULT_FLUSH_TRIGGER)).start()
