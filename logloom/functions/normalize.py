"""Text lines to log entries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from logloom.functions.json_text import (
    bind,
    canonical_numbers,
    is_json_null,
    js_trim,
    json_kind,
    scalar_text,
    text_to_boolean,
    with_parsed,
)
from logloom.functions.times import date_prefix
from logloom.schema import PROMOTED_FIELDS

DEFAULT_LEVEL = "INFO"
DEFAULT_EVENT = "log.event"
INGESTED, BLANK, BAD = "record", "blank", "parse_error"
_TYPED = ("timestamp", "level", "event", "message", "audit")  # members that are read by their kind


def has_audit_segment(path: Column) -> Column:
    return F.contains(F.lower(path), F.lit("/audit/"))


def is_audit_file(path: Column) -> Column:
    """File-level audit test: an ``audit`` folder on the path, or ``audit`` in the file name."""
    lowered = F.lower(path)
    return has_audit_segment(path) | F.contains(F.substring_index(lowered, "/", -1), F.lit("audit"))


def classify_lines(lines: DataFrame) -> DataFrame:
    """Add ``parsed`` (variant or NULL) and ``line_kind``; ``line`` becomes trimmed.

    A bare ``null`` is counted as a parse error.
    """
    parsed = with_parsed(lines.withColumn("line", js_trim(F.col("line"))), "line")
    return parsed.withColumn(
        "line_kind",
        F.when(F.col("line") == "", F.lit(BLANK))
        .when(F.col("parsed").isNull() | is_json_null("parsed"), F.lit(BAD))
        .otherwise(F.lit(INGESTED)),
    )


def normalize(records: DataFrame, now: str) -> DataFrame:
    """Turn classified record lines into entry columns.

    Reads ``line``, ``parsed`` and ``path``; other columns pass through. ``now`` is the ISO
    text used where a record has no timestamp of its own.
    """
    # Both maps list the members in the same order. Texts are made once for all members: taking a variant
    # out of a line and casting it costs more than everything else here.
    members = F.try_variant_get(F.col("parsed"), "$", "map<string,variant>")
    as_text = F.try_variant_get(F.col("parsed"), "$", "map<string,string>")
    found = bind(records, _kinds=F.transform_values(members, lambda _, value: json_kind(value)), _texts=as_text)
    typed = bind(
        found.drop("parsed"),
        _names=F.map_keys("_kinds"),
        **{f"_{name}_kind": F.coalesce(F.try_element_at("_kinds", F.lit(name)), F.lit("ABSENT")) for name in _TYPED},
        **{f"_{name}_text": F.try_element_at("_texts", F.lit(name)) for name in _TYPED},
    )

    def kind(name: str) -> Column:
        return F.col(f"_{name}_kind")

    def text(name: str) -> Column:
        return F.col(f"_{name}_text")

    def non_empty_string(name: str) -> Column:
        return F.when(kind(name) == "STRING", F.nullif(text(name), F.lit("")))

    message_kind = kind("message")
    message = (
        F.when(message_kind.isin("ABSENT", "VOID"), F.lit(""))
        # Nested values keep the key order of the line, which a variant does not. Of repeated
        # members this reads the last, as the parser does.
        .when(
            message_kind.startswith("OBJECT") | message_kind.startswith("ARRAY"),
            canonical_numbers(F.from_json("line", "message string")["message"]),
        )
        .otherwise(scalar_text(text("message"), message_kind))
    )
    audit_kind = kind("audit")
    audit_value = (
        F.when(audit_kind == "BOOLEAN", text("audit") == "true")
        .when(
            audit_kind.startswith("DECIMAL") | audit_kind.isin("BIGINT", "DOUBLE"),
            text("audit").try_cast("double") != 0,
        )
        .when(audit_kind == "STRING", text_to_boolean(text("audit")))
    )
    texts = F.map_from_arrays("_names", F.zip_with(F.map_values("_texts"), F.map_values("_kinds"), scalar_text))
    fields = F.coalesce(
        F.map_filter(texts, lambda _, value: value.isNotNull()),
        F.create_map().cast("map<string,string>"),
    )
    derived = {
        "timestamp": F.coalesce(non_empty_string("timestamp"), F.lit(now)),
        "level": F.coalesce(F.upper(non_empty_string("level")), F.lit(DEFAULT_LEVEL)),
        "event": F.coalesce(non_empty_string("event"), non_empty_string("message"), F.lit(DEFAULT_EVENT)),
        "message": message,
        "is_audit": F.coalesce(audit_value, has_audit_segment(F.col("path"))),
        "data_json": F.col("line"),
        "fields": fields,
    }
    kept = [name for name in records.columns if name not in ("parsed", "line", *derived)]
    promoted = {column: F.try_element_at("fields", F.lit(name)) for name, column in PROMOTED_FIELDS.items()}
    return typed.select(*kept, *[value.alias(name) for name, value in derived.items()]).withColumns(
        {"event_date": date_prefix(F.col("timestamp")), **promoted}
    )


def entries_from_lines(lines: DataFrame, now: str) -> DataFrame:
    """Entries of every line that holds a record; blank and broken lines drop out."""
    records = classify_lines(lines).where(F.col("line_kind") == INGESTED).drop("line_kind")
    return normalize(records, now)
