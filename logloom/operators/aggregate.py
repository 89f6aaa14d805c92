"""Grouped counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from logloom.operators.filters import DEFAULT_BUCKET_LIMIT, LogQuery, clamp_limit, field_value

MISSING = "(missing)"
GROUP_MODES = ("level", "event", "correlation", "field")


def bucket_key(group_by: str, group_field: str | None = None) -> Column:
    if group_by in ("level", "event"):
        return F.col(group_by)
    if group_by == "correlation":
        return F.coalesce(field_value("correlationId"), field_value("requestId"), F.lit(MISSING))
    if group_by == "field":
        name = (group_field or "").strip()
        if not name:
            raise ValueError("groupField is required when groupBy=field")
        return F.coalesce(field_value(name), F.lit(MISSING))
    raise ValueError(f"group_by must be one of {', '.join(GROUP_MODES)}")


def aggregate_logs(
    entries: DataFrame,
    query: LogQuery,
    group_by: str,
    group_field: str | None = None,
) -> DataFrame:
    """Top buckets (``key``, ``count``), largest first, ties by key.

    Counts are combined on the map side, so one dominant key costs one row per task.
    """
    key = bucket_key(group_by, group_field)
    limit = clamp_limit(query.limit, DEFAULT_BUCKET_LIMIT)
    return (
        entries.where(query.without_paging().predicate())
        .groupBy(key.alias("key"))
        .agg(F.count("*").alias("count"))
        .orderBy(F.col("count").desc(), F.col("key").asc())
        .limit(limit)
    )
