"""Newest-first pages over entries."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import chain, islice

from pyspark.sql import Column, DataFrame, Row, functions as F

from logloom.operators.filters import (
    DEFAULT_PAGE_LIMIT,
    Cursor,
    LogQuery,
    after_cursor,
    all_of,
    clamp_limit,
)

PAGE_COLUMNS = ["id", "timestamp", "level", "event", "message", "data_json", "source_file", "line_number"]
GROWTH = 4  # how many times as many files each further step reads


@dataclass(frozen=True)
class LogPage:
    entries: list[Row]
    has_more: bool
    limit: int
    next_cursor: str | None


@dataclass(frozen=True)
class Zone:
    """A data file, the newest timestamp in it and its number of rows."""

    path: str
    max_time: str
    rows: int


def matching(entries: DataFrame, query: LogQuery) -> DataFrame:
    """Entries that satisfy the filters and come after the cursor."""
    cursor = Cursor.decode(query.cursor)
    conditions = query.conditions() + (after_cursor(cursor) if cursor else [])
    return entries.where(all_of(conditions)) if conditions else entries


def newest_first(entries: DataFrame) -> DataFrame:
    return entries.orderBy(F.col("timestamp").desc(), F.col("id").desc())


def page_frame(entries: DataFrame, query: LogQuery, look_ahead: int = 0) -> DataFrame:
    """The page as a DataFrame: a distributed top-k, ``look_ahead`` rows longer if asked."""
    limit = clamp_limit(query.limit, DEFAULT_PAGE_LIMIT)
    return newest_first(matching(entries, query).select(*PAGE_COLUMNS)).limit(limit + look_ahead)


def build_page(rows: list[Row], limit: int) -> LogPage:
    """Cut the look-ahead row off ``rows`` (at most 1001) and name the next page."""
    shown, has_more = rows[:limit], len(rows) > limit
    next_cursor = Cursor(shown[-1]["timestamp"], shown[-1]["id"]).encode() if has_more and shown else None
    return LogPage(shown, has_more, limit, next_cursor)


def fetch_page(entries: DataFrame, query: LogQuery) -> LogPage:
    limit = clamp_limit(query.limit, DEFAULT_PAGE_LIMIT)
    return build_page(page_frame(entries, query, look_ahead=1).collect(), limit)


def newest_rows(
    zones: Iterator[list[Zone]], read: Callable[[list[str]], DataFrame], query: LogQuery, count: int, first_files: int
) -> list[Row]:
    """The ``count`` newest matches, from data files given by their newest timestamp, latest first.

    Files are read a few at a time, each once, and what was found is kept. The search ends when the last row
    kept is newer than everything in the files that remain. (Python and Spark order text alike.)
    """
    rest = chain.from_iterable(zones)
    ahead = next(rest, None)
    found: list[Row] = []
    files = first_files
    while ahead is not None and (len(found) < count or found[-1]["timestamp"] <= ahead.max_time):
        wave = [ahead, *islice(rest, files - 1)]
        rows = page_rows(read([z.path for z in wave]), query, count)
        found = sorted([*found, *rows], key=lambda r: (r["timestamp"], r["id"]), reverse=True)[:count]
        ahead = next(rest, None)
        files *= GROWTH
    return found


def page_rows(entries: DataFrame, query: LogQuery, count: int) -> list[Row]:
    return newest_first(matching(entries, query).select(*PAGE_COLUMNS)).limit(count).collect()


def count_logs(entries: DataFrame, query: LogQuery) -> DataFrame:
    """One row ``count``. Keys are unique within an entry, so no distinct is needed."""
    return entries.where(query.without_paging().predicate()).agg(F.count("*").alias("count"))


def result_json(entries: DataFrame) -> DataFrame:
    """One JSON object per entry with its record parsed back under ``data``."""
    record: Column = F.parse_json("data_json")
    return entries.select(
        "timestamp",
        "id",
        F.to_json(
            F.struct(
                "id",
                "timestamp",
                "level",
                "event",
                "message",
                record.alias("data"),
                F.col("source_file").alias("sourceFile"),
                F.col("line_number").alias("lineNumber"),
            )
        ).alias("entry_json"),
    )
