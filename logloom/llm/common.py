"""What several operators of this subpackage share."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import sys
import types
import weakref
from collections.abc import Callable
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from logloom.session import configure, scratch_path
from logloom.sources.files import delete_path

WORD = r"[^\x20\x09-\x0D]+"  # fixed value: a word is a run of other characters than ASCII white space
TASK_ROWS = 50_000  # narrow rows, such as links, that are worth a task of their own
BATCH_BYTES = "4m"  # most bytes in one Arrow batch, so that long texts come in few rows
GIVE_BACK_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_PLACES: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()  # where stored tables lie


def prepare(spark: SparkSession) -> SparkSession:
    """Session settings for tasks that get rows by Arrow."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    return configure(spark)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def stored(frame: DataFrame, label: str) -> DataFrame:
    """The rows written to the shared folder and read again: later steps neither repeat nor lose the work.

    What was shuffled to make them is deleted as soon as they are written.
    """
    spark = frame.sparkSession
    path = scratch_path(spark, label)
    before = spark.conf.get(GIVE_BACK_SHUFFLES, "false")
    spark.conf.set(GIVE_BACK_SHUFFLES, "true")
    try:
        frame.select("*").write.parquet(path)  # planned anew, so the setting holds
    finally:
        spark.conf.set(GIVE_BACK_SHUFFLES, before)
    found = spark.read.schema(frame.schema).parquet(path)
    _PLACES[found] = path
    return found


def dropped(*frames: DataFrame) -> None:
    """Delete stored tables; nothing made of them may be read afterwards, unless it is stored itself."""
    for frame in frames:
        if path := _PLACES.pop(frame, None):
            delete_path(frame.sparkSession, path)


def packed(frame: DataFrame, *names: str) -> DataFrame:
    """Whole rows as ``_row`` beside the named columns, so that no other column's name can clash."""
    row = F.struct(*(F.col(f"`{c}`") for c in frame.columns))
    return frame.select(row.alias("_row"), *names)


def unpacked(frame: DataFrame, columns: list[str], added: dict[str, Column] | None = None) -> DataFrame:
    """The packed columns again; ``added`` ones come in place of, or after, those of their names."""
    added = added or {}
    own = [added.get(c, F.col(f"_row.`{c}`")).alias(c) for c in columns]
    return frame.select(*own, *(column.alias(name) for name, column in added.items() if name not in columns))


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def small(frame: DataFrame, limit: int) -> bool:
    """Whether a frame has at most ``limit`` rows."""
    return frame.limit(limit + 1).count() <= limit


def gathered(frame: DataFrame, rows: int) -> DataFrame:
    """A frame of about ``rows`` narrow rows in no more tasks than these need: each task makes files, however little it has."""
    return frame.coalesce(max(2, -(-rows // TASK_ROWS)))


def give_back() -> None:
    """Hand freed memory back to the system; workers live on beside those of the next stage."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other C libraries do so by themselves
        ctypes.CDLL(None).malloc_trim(0)


def worker_state(key: Any, make: Callable[[], Any]) -> Any:
    """Something that a Python worker makes once and keeps for its later tasks, until it is asked for another."""
    box = sys.modules.setdefault("_llm_worker_state", types.ModuleType("_llm_worker_state")).__dict__
    if box.get("key") != key:
        box.update(key=None, made=None)
        give_back()
        box["made"] = make()
        box["key"] = key
    return box["made"]
