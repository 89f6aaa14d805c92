"""The field index as rows, and the searches written against that form."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from logloom.operators.aggregate import MISSING
from logloom.operators.filters import LogQuery, all_of


def field_rows(entries: DataFrame, id_column: str = "id") -> DataFrame:
    """One row per entry and top-level scalar field: entry_id, key, value_text."""
    return entries.select(
        F.col(id_column).alias("entry_id"),
        F.explode("fields").alias("key", "value_text"),
    )


def semi_join_field(entries: DataFrame, rows: DataFrame, query: LogQuery) -> DataFrame:
    """Entries passing ``query`` with its field test done as a semi-join on field rows.

    For field rows kept as a table of their own; on entries the map lookup of
    ``LogQuery.predicate`` needs no join.
    """
    found = entries.where(all_of(query.conditions(with_field=False)))
    if not query.filters_on_field:
        return found
    hits = rows.where((F.col("key") == query.field) & (F.col("value_text") == query.value))
    return found.join(hits.select(F.col("entry_id").alias("id")), "id", "left_semi")


def left_join_field(entries: DataFrame, rows: DataFrame, name: str, out: str) -> DataFrame:
    """Add field ``name`` from field rows as column ``out``, NULL where an entry lacks it."""
    values = rows.where(F.col("key") == name).select(
        F.col("entry_id").alias("id"), F.col("value_text").alias(out)
    )
    return entries.join(values, "id", "left")


def correlation_by_join(entries: DataFrame, rows: DataFrame) -> DataFrame:
    """Entry id and correlation key, by two left joins on field rows."""
    joined = left_join_field(
        left_join_field(entries.select("id"), rows, "correlationId", "_correlation"), rows, "requestId", "_request"
    )
    return joined.select("id", F.coalesce("_correlation", "_request", F.lit(MISSING)).alias("key"))
